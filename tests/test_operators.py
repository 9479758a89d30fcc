"""Detection, grouping, chunking, records, readers and streams on small fixtures."""

import io
import random
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import boundaries
from quire.operators import chunk, detect, jobs, records
from quire.sources import readers, sinks
from quire.streaming import ingest


def table(spark, text):
    return spark.createDataFrame([("s", text)], "source string, text string")


@pytest.mark.parametrize(("line", "number", "language"), [("Chương 12: Mở đầu", 12, "vi"), ("CHƯƠNG 3", 3, "vi"), ("【第327章】", 327, "zh"), ("第一百零五章", 105, "zh"), ("Chapter 7 - The End", 7, "en"), ("Hồi thứ nhất", None, None), ("第1章 标题", 1, "zh"), ("  ## Tập 4. x", 4, "vi"), ("【00:18】", None, None), ("【12:09:57 — rương báu】", None, None), ("He read Chapter 7.", None, None), ("x" * 201, None, None), ("", None, None), ("Vol.2", 2, "en")])
def test_header_lines(spark, line, number, language):
    h = spark.createDataFrame([(line,)], "line string").select(detect.header_of(F.col("line")).alias("h")).first()["h"]
    assert (h and h["number"], h and h["language"]) == (number, language)


@pytest.mark.parametrize(
    ("line", "number", "title", "header", "body"),
    [
        ("第1章 标题", 1, "标题", "第1章", ""),
        ("[第327章] 流民不可怕", 327, "流民不可怕", "[第327章]", ""),
        ("【第3章】", 3, "", "【第3章】", ""),
        ("第3章：标题", 3, "标题", "第3章", ""),
        ("第3章: Đêm ấy", 3, "", "第3章", "Đêm ấy"),
        ("第327章流民Đêm ấy trời", 327, "", "第327章", "流民Đêm ấy trời"),
        ("第9章ab", 9, "", "第9章", "ab"),
        ("Chương 12Đêm ấy trời mưa", 12, "", "Chương 12", "Đêm ấy trời mưa"),
        ("Chương 12 Mở đầu", 12, "", "Chương 12", "Mở đầu"),
        ("Chương 5: Chạy trốnNàng vội vã đi", 5, "Chạy trốn", "Chương 5: Chạy trốn", "Nàng vội vã đi"),
        ("Chương 5: iPhone", 5, "iPhone", "Chương 5: iPhone", ""),
        ("Chương 5: - Tên -", 5, "Tên", "Chương 5: - Tên -", ""),
        ("Chương 1\r", 1, "", "Chương 1", ""),
        ("Chương " + "9" * 30, None, None, None, None),
        ("第一二章", None, None, None, None),
        ("【4:59:50】", None, None, None, None),
        ("Chương trình 5", None, None, None, None),
        ("Chương 7 " + "dài " * 80, 7, "", "Chương 7", ("dài " * 80).strip()),
    ],
)
def test_whole_and_glued_headers(spark, line, number, title, header, body):
    h = spark.createDataFrame([(line,)], "line string").select(detect.header_of(F.col("line")).alias("h")).first()["h"]
    assert (h and (h["number"], h["title"], h["header"], h["body"])) == (number and (number, title, header, body))


def test_plain_and_custom_patterns(spark):
    rows = spark.createDataFrame([("12. Đầu",), ("#7 - x",), ("10:30 sáng hôm đó",), ("Kapitel <5> Ende",)], "line string")
    plain = detect.build_patterns(plain=True, vietnamese=False)
    own = detect.build_patterns(custom=r"^Kapitel <(?P<number>[0-9]+)>(?P<title>.*)$")
    got = [(r[0] and r[0]["number"], r[1] and (r[1]["number"], r[1]["title"], r[1]["pattern"])) for r in rows.select(detect.header_of(F.col("line"), plain), detect.header_of(F.col("line"), own)).collect()]
    assert got == [(12, None), (7, None), (None, None), (None, (5, "Ende", "custom"))]
    for wrong in ("", "(", "^x$"):
        with pytest.raises(ValueError):
            detect.custom_pattern(wrong)


def test_normalizing(spark):
    text = 'trước\nChương 1: “A”\n \nChương thứ 1\nmột  dòng ,\\nhai\n第2章 标题\n"x"\n第2章 标题\n"xyz"\nChapter 3\n'
    rows = {r["number"]: r for r in detect.normalize(table(spark, text)).collect()}
    assert {n: (r["header"], r["text"]) for n, r in rows.items()} == {1: ("Chương 1: 'A'", "một dòng,\nhai."), 2: ("Chương 2", "'xyz'"), 3: ("Chương 3", "")}
    assert rows[1]["text_loss"] == 17
    report = detect.normalize_report(table(spark, text)).first()
    assert (report["found"], report["chapters"], report["header_artifacts_removed"], report["restored_newlines"], report["periods_added"], report["chinese_titles_removed"], report["double_quotes_normalized"]) == (4, 3, 1, 1, 1, 2, 6)
    assert [r["number"] for r in detect.renumber(detect.normalize(table(spark, text)), first=8).orderBy("number").collect()] == [8, 9, 10]
    assert detect.normalize(table(spark, "no header")).count() == 0
    kept = detect.normalize(table(spark, "## Chương 4: B ==\nx"), options=detect.NormalizeOptions(keep_headers=True)).first()
    assert kept["header"] == "Chương 4: B"
    assert detect.repair_headers(detect.normalize(table(spark, text))).filter("changed").count() == 0


def test_heading_spans_and_numeric_groups(spark):
    text = "lời\r\n" + "".join(f"Chương {n} Tên\r\nthân\u2028x\r" for n in range(601, 701) if n not in (610, 655, 700))
    texts = table(spark, text)
    spans = detect.heading_spans(texts)
    rows = spans.orderBy("start").collect()
    assert [r["number"] for r in rows] == [n for n in range(601, 701) if n not in (610, 655, 700)]
    assert rows[0]["start"] == 5 and rows[0]["line"] == 2 and rows[-1]["end"] == len(text)
    assert all(text[r["start"] : r["body_start"]] == r["heading"] + "\r\n" for r in rows)
    assert detect.plan_groups(spans, 20).count() == 0  # counting would give wrong ranges
    groups = detect.plan_groups(spans, 20, "numeric")
    cut = detect.group_texts(groups, texts).orderBy("ord").collect()
    assert "".join(g["slice"] for g in cut) == text and detect.exact_cover(groups, texts).first()["covered"]
    assert [g["range_label"] for g in cut] == ["601-620", "621-640", "641-660", "661-680", "681-699"]
    marks = detect.numeric_fingerprint(spans, texts, 20)
    ids = detect.group_identity(groups, texts, 20, fingerprints=marks)
    assert ids.select("group_id").distinct().count() == 5
    told = detect.analyze_grouping(spans, 27).first()
    assert (told["needs_numbers"], told["refusal"], [tuple(m) for m in told["missing_starts"]]) == (True, "missing_starts", [(655, 655, 1)])
    twice = detect.analyze_grouping(detect.heading_spans(table(spark, "Chương 1\nChương 3\nChương 3\nChương 9")), 2).first()
    assert twice["refusal"] == "ambiguous"
    with pytest.raises(ValueError):
        detect.plan_groups(spans, 0)


def test_chapters_and_duplicates(spark):
    text = "preamble\nChương 1: A\nngắn\n第1章\n很长很长很长很长\nChương 2\nx\nChương 2: B\ny\nChương 5\nz"
    found = {(r["number"], r["source_line"]): r for r in detect.chapters(table(spark, text)).collect()}
    assert found[None, 0]["text"] == "preamble"
    kept = {r["number"]: r for r in detect.dedupe(detect.chapters(table(spark, text)).filter("section > 0")).collect()}
    assert kept[1]["language"] == "vi" and kept[2]["title"] == "B"
    reasons = {(r["number"], r["source_line"]): r["reason"] for r in detect.rank_variants(detect.chapters(table(spark, text)).filter("section > 0")).collect()}
    assert reasons[1, 3] == "language" and reasons[2, 5] == "no_title"
    assert [tuple(r)[1:] for r in detect.sequence_gaps(detect.headers(table(spark, text))).collect()] == [(3, 4, 2)]
    again = detect.chapters(table(spark, text).repartition(3)).orderBy("section").collect()
    assert again == detect.chapters(table(spark, text)).orderBy("section").collect()


@pytest.mark.parametrize("size", [7, 10, 25, 200])
def test_groups_reproduce_the_text(spark, size):
    text = "lời đầu\n" + "\n".join(f"Chương {n}\n" + "chữ " * (n % 5) for n in range(1, 101))
    texts = table(spark, text)
    groups = detect.group_texts(detect.group_by_count(detect.heading_spans(texts), size), texts).orderBy("ord").collect()
    assert len(groups) == -(-100 // size)
    assert "".join(g["slice"] for g in groups) == text
    assert detect.exact_cover(detect.group_by_count(detect.heading_spans(texts), size), texts).first()["covered"]


PROSE = ["Một câu. Hai câu! " * 200, "x" * 3000, "a" + "\u0301" + "b " * 900, "không dấu chấm, " * 150, "“Đi đi.” Anh nói. " * 100, "3.14 " * 400, "short", "Dr. No said v1.2.3 is at a.vn, (see). " * 60]


@pytest.mark.parametrize("text", PROSE)
def test_chunks_lose_nothing(spark, text):
    texts = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "...")], "doc_id long, text string")
    chunks = chunk.plan(texts)
    rows = chunks.orderBy("ord").collect()
    assert "".join("".join(r["text"].split()) for r in rows) == "".join(text.split())
    assert all(0 < r["chars"] <= chunk.SOFT and r["error"] is None for r in rows)
    assert [r["lossless"] for r in chunk.integrity(texts, chunks).collect()] == [True]
    assert not chunk.integrity(texts, chunks.filter("ord > 0") if len(rows) > 1 else chunks.filter("false")).first()["lossless"]


def farthest(text, limit):
    """Chunks by the rule itself, character by character: no lists of places, no search."""
    spans = boundaries.protected_spans(text)
    held = [any(a <= i < b for a, b in spans) for i in range(len(text))]
    quoted = [h or any(m.start() <= i < m.end() and m.end() - m.start() <= limit for m in re.finditer(boundaries.QUOTATION, text)) for i, h in enumerate(held)]
    runs = lambda p: {m.end() for m in re.finditer(p, text) if not any(held[m.start() : m.end()])}
    spaces = {m.end() for m in re.finditer(r"\s+", text) if not held[m.start()]}
    outside = lambda c: c == len(text) or not (quoted[c - 1] and quoted[c])
    clauses = runs(boundaries.CLAUSE)
    levels = [runs(boundaries.ENDING), set(filter(outside, clauses)), clauses, set(filter(outside, spaces)), spaces]
    out, start = [], 0
    while start < len(text):
        cut = len(text) if len(text) - start <= limit else None
        for places in levels:
            if cut is None:
                last = next((c for c in range(start + limit, start, -1) if c in places), None)
                if last and text[last:].lstrip()[:1] not in tuple(boundaries.LOOSE):
                    cut = last
        if cut is None:
            cut = next(c for c in range(start + limit, start, -1) if not held[c - 1] and not unicodedata.combining(text[c]))
        piece = text[start:cut].strip()
        if boundaries.spoken(piece):
            out.append(piece)
        elif piece and out:
            out[-1] += piece
        start = cut
    return out


def test_chunks_end_at_the_farthest_place():
    rng = random.Random(5)
    bits = ["Anh đi", ". ", "! ", ", ", " ", "“Có mà.” ", "3.14", " a.b@c.vn ", "\n", "…", "(x) ", "từ dài quá", "e\u0301", "» "]
    for text in (*PROSE, *("".join(rng.choice(bits) for _ in range(120)) for _ in range(60))):
        for limit in (90, 300):
            assert [c[0] for c in boundaries.plan_chunks(text, limit, 2000)] == farthest(text, limit)


def test_pages_and_errors(spark):
    budget = chunk.PageBudget(columns=20, lines=6)
    texts = spark.createDataFrame([(1, "Một câu dài vừa. " * 80, "k"), (2, "http://" + "x" * 900, "k")], "doc_id long, text string, path string")
    rows = chunk.plan(texts, budget=budget).orderBy("doc_id", "ord").collect()
    assert all(r["visible_lines"] <= 6 and budget.fits(r["text"]) and r["path"] == "k" for r in rows if r["error"] is None)
    assert [r["error"] for r in rows if r["doc_id"] == 2] == ["protected_token_exceeds_limit"]
    assert {r["reason"] for r in rows if r["doc_id"] == 1} == {"next_unit_would_exceed_page_height", "end_of_text"}
    stats = chunk.fill_statistics(chunk.plan(texts, budget=budget), budget, ["path"]).first()
    assert stats["lines_max"] == 6 and stats["fill_max"] == 1.0 and stats["limited_chunks"] > 5


def test_long_text_in_linear_time(spark):
    """20 million characters in one row."""
    texts = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("Một câu khá dài, có hai vế. "), 700_000).alias("text"))
    assert chunk.plan(texts).agg(F.sum("chars")).first()[0] > 19_000_000


def test_chapter_parts(spark):
    rows = [("s", 1, 0, "Chương 1", "", "Một câu. " * 200), ("s", 2, 9, "Chương 2", "B", "..."), ("s", 3, 12, "", "", "ngắn")]
    chapters = spark.createDataFrame(rows, "source string, number long, source_line long, header string, title string, text string")
    made = chunk.plan_chapters(chapters, with_header=True)
    got = [(r["number"], r["part"], r["parts"], r["ord"], r["reason"]) for r in made.orderBy("ord").collect()]
    assert got == [(1, 1, 4, 1, "chapter_heading"), (1, 2, 4, 2, "character_limit"), (1, 3, 4, 3, "character_limit"), (1, 4, 4, 4, "end_of_text"), (2, 1, 1, 5, "chapter_heading"), (3, 1, 1, 6, "end_of_text")]
    codes = {(r["number"], r["code"]) for r in chunk.chunk_diagnostics(chapters, chunk.plan_chapters(chapters)).collect()}
    assert codes == {(2, "empty_chapter"), (3, "short_chunk")}


def test_jobs(spark):
    states = jobs.map_with_retry(spark.createDataFrame([(1, "a"), (2, "bad")], "k long, v string"), "k", "v", lambda v: v.upper() if v != "bad" else 1 / 0, attempts=3)
    assert {(r["k"], r["result"], r["error"] and r["error"][:17], r["tries"]) for r in states.collect()} == {(1, "A", None, 1), (2, None, "ZeroDivisionError", 3)}
    assert jobs.settings_identity(b=1, a=chunk.PageBudget()) == '{"a":{"columns":48,"lines":14},"b":1}'


def test_files(spark, tmp_path):
    groups = spark.createDataFrame([("s", 1, "g1", "Chương 1", "1", 0, 3, "abc"), ("s", 2, "g2", "Chương 2", "2", 3, 5, "de")], "source string, ord long, group_id string, label string, range_label string, start long, end long, slice string")
    groups = groups.withColumn("name", F.concat_ws("_", "source", "range_label")).withColumn("source_sha256", F.sha2(F.lit("abcde"), 256)).withColumn("text_sha256", F.sha2("slice", 256))
    files = sinks.group_files(groups)
    assert {r["filename"] for r in files.collect()} == {"s_1/final.txt", "s_1/final.json", "s_2/final.txt", "s_2/final.json", "chapter_groups.json"}
    sums = groups.join(files.filter("filename LIKE '%.json'").select(F.split("filename", "/")[0].alias("name"), F.sha2("content", 256).alias("json_sha256")), "name")
    assert [r["valid"] for r in jobs.file_states(sums, files).collect()] == [True, True]
    spoilt = files.withColumn("content", F.when(F.col("filename") == "s_1/final.txt", "x").otherwise(F.col("content"))).filter("filename <> 's_2/final.json'")
    assert {(r["group_id"], r["reason"]) for r in jobs.file_states(sums, spoilt).collect()} == {("g1", "modified"), ("g2", "missing")}
    for _ in range(2):
        assert sinks.write_files(files, str(tmp_path / "out")).count() == 5
    assert (tmp_path / "out/s_1/final.txt").read_text() == "abc" and len(list((tmp_path / "out").rglob("*.*"))) == 5
    zipped = sinks.archives(files).first()["archive"]
    with zipfile.ZipFile(io.BytesIO(zipped)) as z:
        assert z.read("s_2/final.txt") == b"de" and len(z.namelist()) == 5


def test_ranges(spark):
    assert records.parse_ranges("1-3, 9, 7-5, x, 10 – 12, 4 - 6,1;2") == [(1, 3), (9, 9), (4, 6)]
    rows = spark.range(20).withColumnRenamed("id", "number")
    assert records.in_ranges(rows, []).count() == 20
    assert [r[0] for r in records.in_ranges(rows, [(1, 3), (9, 9)]).orderBy("number").collect()] == [1, 2, 3, 9]


def test_worklist_and_headers(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, sha string")
    done = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "k long, sha string")
    assert [r["k"] for r in records.worklist(items, done, ["k", "sha"]).collect()] == [2]
    rows = spark.createDataFrame([("g", 1, None), ("g", 2, None), ("g", 3, 10), ("g", 4, None), ("g", 5, 3), ("g", 6, None)], "grp string, ord long, number long")
    assert [r["assigned"] for r in records.insert_headers(rows).orderBy("ord").collect()] == [1, 2, 10, 11, 3, 4]


def test_decoding():
    told = lambda data: (readers.decode(data).text, readers.decode(data).encoding)
    assert told(b"") == ("", "utf-8")
    assert told("chào".encode("utf-16"))[1] == "utf-16"
    assert told(b"\xef\xbb\xbfabc") == ("abc", "utf-8-sig")
    assert told("plain text".encode())[0] == "plain text"


def test_reading_files_and_archives(spark, tmp_path):
    (tmp_path / "b 10.txt").write_text("ten", encoding="utf-8")
    (tmp_path / "b 2.txt").write_text("two", encoding="utf-8")
    (tmp_path / "README.md").write_text("no", encoding="utf-8")
    (tmp_path / "x.pdf").write_text("no", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/c 1.txt", "one")
        z.writestr("__MACOSX/c.txt", "no")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    rows = readers.read_texts(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["name"], r["text"], r["error"]) for r in rows] == [("b 2.txt", "two", None), ("b 10.txt", "ten", None), ("bad.zip", None, "file_unreadable"), ("in/c 1.txt", "one", None)] or {(r["name"], r["text"]) for r in rows} == {("b 2.txt", "two"), ("b 10.txt", "ten"), ("bad.zip", None), ("in/c 1.txt", "one")}
    assert [r["name"] for r in readers.read_texts(spark, str(tmp_path), include=["C 1"]).collect()] == ["in/c 1.txt"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("x")
    assert "deep.txt" not in [r["name"] for r in readers.read_texts(spark, str(tmp_path)).collect()]
    assert "deep.txt" in [r["name"] for r in readers.read_texts(spark, str(tmp_path), recursive=True).collect()]
    lost = readers.read_texts(spark, [str(tmp_path / "b 2.txt"), str(tmp_path / "none.txt")]).orderBy("name").collect()
    assert [(r["name"], r["error"]) for r in lost] == [("b 2.txt", None), ("none.txt", "path_missing")]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    rows.write.parquet(source)
    for _ in range(2):
        ingest.run_available(spark.readStream.schema(rows.schema).parquet(source), state, target)
    assert spark.read.parquet(target).count() == 2
    spark.createDataFrame([(3, "c")], "k long, v string").write.mode("append").parquet(source)
    ingest.run_available(spark.readStream.schema(rows.schema).parquet(source), state, target)
    assert spark.read.parquet(target).count() == 3


def test_steps_run_only_on_what_they_look_for():
    from quire.functions.sanitizing import Sanitizer, Text
    from quire.operators.clean import FIXED, LABELS, SanitizeOptions, sanitize_counters

    class Used(dict):
        def __getitem__(self, name):
            used.add(name)
            return super().__getitem__(name)

    used: set[str] = set()
    options = SanitizeOptions()
    one = Sanitizer(options, FIXED, {"urls": LABELS["link"], "emails": LABELS["mail"]}, sanitize_counters(options))
    one.p = Used(one.p)
    for text, steps in (("Một câu không có dấu\nnữa", set()), ("a, b. C", {"no_space_after"}), ("x • y “z” …", {"bullet", "decoration", "space_before", "ellipsis", "no_space_after"})):
        used.clear()
        one(text)
        assert used - {"detected_other_script_chars", "spoken"} == steps, text  # told by first bytes, which letters share
    for text, spans in (("ab cd 3.14 ef, gh 5.6. i j", [(6, 10, False), (18, 21, False)]), ("3.14", [(0, 4, False)]), ("a 1.2 3.4 b", [(2, 5, True), (6, 9, False)]), ("word 1.2", [(5, 8, False)])):
        t = Text(text)
        t.spans = spans
        t.join(*t.parted())
        assert (t.text, t.spans) == (text, spans)


def test_plans_look_for_what_they_need(spark, monkeypatch):
    """Places after words are looked for only where sentences and clauses won't do, texts are cut into lines only where one begins as a header."""
    from pyspark.sql import functions as F

    from quire.functions import boundaries
    from quire.operators import detect

    asked = []
    blanks = boundaries.Places.blanks
    monkeypatch.setattr(boundaries.Places, "blanks", lambda self: asked.append(self.text) or blanks(self))
    assert len(boundaries.plan_chunks("Một câu. Hai câu! " * 200, 700, 2000)) > 4 and not asked
    assert boundaries.plan_chunks("không dấu chấm " * 150, 700, 2000) and asked

    texts = ["a\nb", "Chương 1\nx", "x\r\n　 ## Chapter 2: y", "x\x1e 【第三章】", "x  hồi 4", "x\x0b>> Part 5\n", "x Chương 6", "\n\n \r\tVol. 7", "", "x\x85Quyển 8 "]
    rows = spark.createDataFrame(list(enumerate(texts)), "source long, text string")
    number = detect.heading_number(F.col("line"))
    wanted = sorted((r["source"], r["number"]) for r in detect.physical_lines(rows).select("source", number.alias("number")).filter("number is not null").collect())
    got = sorted((r["source"], r["number"]) for r in detect.heading_spans(rows).collect())
    assert got == wanted and len(got) > 4
