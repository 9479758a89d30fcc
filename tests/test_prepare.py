"""Plans of groups from end to end, reading and settings, user expressions, sanitizing against its rules."""

import codecs
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import expressions
from quire.operators import chunk, clean, detect, prepare, settings
from quire.sources import readers

NOVEL = "lời tựa\n" + "\n".join(f"Chương {n}: Mở\n“Anh đi.. đâu?” , cô hỏi. " + f"Câu số {n} dài vừa đủ. " * 60 for n in range(1, 7))


def groups_of(spark, texts, size=2):
    df = spark.createDataFrame(texts, "source string, text string")
    spans = detect.heading_spans(df)
    made = detect.group_identity(detect.plan_groups(spans, size), df, size)
    return detect.group_texts(made, df).withColumn("revision", F.lit(1)), spans


def test_plans_are_made_once(spark):
    texts = [("a", NOVEL), ("b", NOVEL.replace("Câu", "Đoạn")), ("c", "Chương 1\n!!! ...\nChương 2\nhttps://" + "x" * 3000)]
    groups, spans = groups_of(spark, texts)
    options = prepare.PrepareOptions(budget=chunk.PageBudget(40, 9), sanitizing=clean.SanitizeOptions(links="keep"))
    first = prepare.prepare(groups, spans, options=options)
    states = {r.group_id: (r.state, r.problem) for r in first.states.collect()}
    assert sorted(s for s, _ in states.values()) == ["failed"] + ["fresh"] * 6
    assert {p for s, p in states.values() if s == "failed"} == {"protected_token_exceeds_limit"}
    chunks = first.chunks.orderBy("group_id", "ord").collect()
    assert all(r.error is None and not r.edited and (r.visible_lines or 0) <= 9 and "“" not in r.text and ".." not in r.text for r in chunks)
    whole = {}
    for r in chunks:
        whole[r.group_id] = whole.get(r.group_id, "") + r.text
        assert r.ord == 1 + len([c for c in chunks if c.group_id == r.group_id and c.ord < r.ord])
    assert any(t.startswith("lời tựaChương 1: Mở'Anh đi. đâu?', cô hỏi.") for t in whole.values())

    saved = spark.createDataFrame(first.fresh.collect(), first.fresh.schema)
    again = prepare.prepare(groups, spans, saved, options=options)
    assert {r.state for r in again.states.collect()} == {"reused", "failed"} and again.fresh.count() == 0
    assert sorted(again.chunks.collect()) == sorted(chunks)

    # a text that changed: its groups only, those before it excepted
    new_groups, new_spans = groups_of(spark, [("a", NOVEL.replace("Câu số 6", "Câu thứ 6")), *texts[1:]])
    third = prepare.prepare(new_groups, new_spans, saved, options=options)
    fresh = third.states.filter("state = 'fresh'").join(new_groups, "group_id").select("source", "ord").collect()
    assert {r.source for r in fresh} == {"a"} and third.fresh.select("group_id").distinct().count() == len(fresh)
    # any setting: all of them
    for other in (prepare.PrepareOptions(budget=chunk.PageBudget(40, 8), sanitizing=options.sanitizing), prepare.PrepareOptions(budget=options.budget, sanitizing=clean.SanitizeOptions(links="keep", emoji=False))):
        assert prepare.prepare(groups, spans, saved, options=other).states.filter("state = 'reused'").count() == 0


def test_overrides_and_pages(spark):
    groups, spans = groups_of(spark, [("a", NOVEL)])
    budget = chunk.PageBudget(40, 9)
    options = prepare.PrepareOptions(budget=budget)
    saved = prepare.prepare(groups, spans, options=options).fresh
    plan = saved.select("plan_id").orderBy("plan_id").first()[0]
    overrides = spark.createDataFrame([(plan, 1, "Sửa."), (plan, 2, "!!!"), (plan, 3, "dài quá " * 200), ("old", 1, "x")], "plan_id string, ord long, text string")
    got = {r.ord: r for r in prepare.prepare(groups, spans, saved, overrides, options).chunks.filter(F.col("plan_id") == plan).collect()}
    assert (got[1].text, got[1].edited, got[1].error) == ("Sửa.", True, None) and (got[2].error, got[3].error) == ("invalid", "over_budget") and not got[4].edited
    assert {r.state for r in prepare.page_states(saved, budget).collect()} == {"current"}
    assert {r.state for r in prepare.page_states(saved, chunk.PageBudget(40, 5)).collect()} >= {"over_budget"}
    assert "moved" in {r.state for r in prepare.page_states(saved, chunk.PageBudget(60, 9)).collect()}


def test_settings(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"quote_mode": "keep", "symbol_map": 5, "unknown": 1, "encoding_chain": [], "custom_rules": [{"pattern": "(a)", "replacement": "\\1b"}, {"pattern": ""}], "detect_english": False, "zero_pad": 3, "tts_preprocessing": {"url_policy": "keep", "max_blank_lines": 2}}))
    got = settings.load_settings(spark, str(path))
    assert got.quote_mode == "keep" and got.symbol_map == clean.SYMBOL_WORDS and got.encoding_chain == settings.Settings().encoding_chain
    assert got.clean_options().rules == (clean.Rule("(a)", "\\1b"),) and got.normalize_options().zero_pad == 3
    assert [p.name for p in got.patterns()] == ["vietnamese", "chinese"] and (got.sanitize_options().links, got.sanitize_options().blank_lines) == ("keep", 2)
    assert settings.coerced(json.loads(got.to_json())) == got
    (tmp_path / "bad.json").write_text("{")
    for missing in ("bad.json", "none.json"):
        assert settings.load_settings(spark, str(tmp_path / missing)) == settings.Settings()
    assert settings.checked({"zero_pad": 2}).zero_pad == 2
    for wrong in ({"nope": 1}, {"zero_pad": "2"}, {"zero_pad": True}, {"zero_pad": 13}, {"encoding_chain": []}, {"encoding_chain": ["x-none"]}, {"bracket_pairs": ["("]}, {"custom_rules": ["x"]}, {"symbol_map": {"a": 1}}, {"min_chunk_chars": 900}, {"quote_mode": "x"}, {"use_custom_chapter_regex": True, "custom_chapter_regex": "("}, {"tts_preprocessing": {"x": 1}}):
        with pytest.raises(ValueError):
            settings.checked(wrong)


def test_encodings_and_places(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "ab"
    a.mkdir(), b.mkdir()
    (a / "1.txt").write_bytes("Tiếng Việt".encode("utf-16"))
    (a / "2.txt").write_bytes("một".encode())
    (b / "3.txt").write_bytes("ba".encode("cp1258"))
    with zipfile.ZipFile(b / "z.zip", "w") as z:
        z.writestr("4.txt", "hai")
    rows = {r.name: r for r in readers.read_texts(spark, [str(b), str(a)], sort="selection").collect()}
    assert [r.name for r in sorted(rows.values(), key=lambda r: r.ord)] == ["3.txt", "4.txt", "1.txt", "2.txt"]  # a isn't taken for ab
    assert rows["1.txt"].text.lstrip("\ufeff") == "Tiếng Việt" and "passed over" in rows["1.txt"].note and readers.decode(b"").note() == "empty file"
    assert not any(r.uncertain for r in rows.values())
    sure = readers.decode(b"\x81\xff", ("ascii",))
    assert sure.uncertain and sure.encoding == "latin-1" and "ascii" in sure.passed_over
    data = spark.createDataFrame([(1, bytearray(codecs.BOM_UTF8 + b"x")), (2, bytearray(codecs.BOM_UTF16_LE + b"x\0")), (3, bytearray(b"x"))], "i int, d binary")
    marks = [r[0] for r in data.orderBy("i").select(readers.had_mark(F.col("d"))).collect()]
    assert marks[0].startswith("utf-8") and marks[1].startswith("utf-16") and marks[2] is None


# ---------------------------------------------------------------- users' expressions


def test_rules_are_pythons(spark):
    rules = [clean.Rule(r"(?P<n>X+)y", r"<\g<n>>"), clean.Rule(r"\p{Lu}", "?"), clean.Rule("a.b", "literal", regex=False), clean.Rule(r"(q)", r"\2"), clean.Rule(r"\d+(?=k)", "#")]
    assert [i for i, _ in clean.rule_problems(rules)] == [1, 3]
    assert "bad escape" in dict(clean.rule_problems(rules))[1]
    rows = spark.createDataFrame([(1, "XXy a.b 12k 13 q"), (2, "none"), (3, None)], "i long, text string")
    options = clean.CleanOptions(brackets="keep", quotes="keep", symbols={}, rules=rules, spacing=False, html=False)
    got = {r.i: (r.text, r.custom_rule_hits) for r in clean.clean(rows, options).collect()}
    assert got == {1: ("<XX> literal #k 13 q", 3), 2: ("none", 0), 3: ("", 0)}


def test_needed_literals():
    want = {"abc": "abc", "a+bcd?": "bc", "(?:foo|bar)baz": "baz", "(?i)abc": "", "(?i:ab)cde": "cde", "[ab]xyz{2,}": "xy", "(?:ab)*q": "q", "a|b": "", "x(?=yz)v": "x", r"(ab)\1c": "ab"}
    assert {p: expressions.needed_literal(p) for p in want} == want


def test_custom_headers_are_pythons(spark):
    texts = spark.createDataFrame([("s", "Kapitel <5> Ende\nx\nkein Kapitel <6>\nKapitel <99999999999999999999>\ny")], "source string, text string")
    own = detect.build_patterns(vietnamese=False, english=False, chinese=False, custom=r"Kapitel <(?P<number>[^\W_]+)>(?P<title>.*)$")
    assert [(r.number, r.title) for r in detect.headers(texts, patterns=own).collect()] == [(5, "Ende")]
    assert [(r.number, r.line) for r in detect.heading_spans(texts, patterns=own).collect()] == [(5, 1)]
    assert [r.number for r in detect.chapters(texts, patterns=own).orderBy("section").collect()] == [5]


def test_headers_are_found_and_put(spark):
    rows = spark.createDataFrame([("g", 1, "x"), ("g", 2, "Chương 7\na\nChương 3\nb"), ("g", 3, "y"), ("g", 4, " "), ("g", 5, "z")], "grp string, ord long, text string")
    got = {r.ord: (r.assigned, r.text.split("\n")[0]) for r in detect.auto_headers(rows).collect()}
    assert got == {1: (1, "Chương 1"), 2: (7, "Chương 7"), 3: (8, "Chương 8"), 4: (None, " "), 5: (9, "Chương 9")}


# ---------------------------------------------------------------- sanitizing


def sane(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r["text"] for r in clean.sanitize(rows, clean.SanitizeOptions(**options)).orderBy("i").collect()]


def test_nothing_stands_in_for_anything(spark):
    private = [chr(c) for c in (*range(0xE000, 0xE010), 0xF8FF, 0xF0000, 0x10FFFD)]
    texts = [f"Icon {c} first, then 3.14 and 2.71 end, {c}v1.2.3" for c in private]
    deep = '{"a": ' * 50 + '"x.. y"' + "}" * 50
    texts += [f"trước.. {deep} sau..", f"Ã© {private[4]} 1.2.3..", "e\u200b\u0301 & x", "e\u200b\u0301 x", '{"a": {"b": {"c": {"d": {"e": 1}}}}} "q"']
    got = sane(spark, texts)
    assert got[: len(private)] == texts[: len(private)]
    assert got[len(private) :] == [f"trước. {deep} sau.", f"Ã© {private[4]} 1.2.3.", "é & x", "é x", "{\"a\": {\"b\": {\"c\": {\"d\": {\"e\": 1}}}}} 'q'"]
    assert sane(spark, got) == got


def test_random_mixtures_keep_their_tokens(spark):
    rng = random.Random(17)
    tokens = ["3.14", "https://a.vn/x?y=1", "a.b@c.vn", '{"k": "v..w", "n": {"m": [1,2]}}', "12:30:45", "v1.2.3", "U.S.", "C:\\x\\y..z", "\ue004", "\ue005", "Ã©", "â€™", "đoạn", "key:value"]
    noise = [" ", "  ", "...", "!!", " , ", "\n\n\n", "“", "”", "\u200b", "\x07", "。", "!?!", " .. ", "\u0301", "&amp;", "*x*", "<b>y</b>"]
    texts = [" ".join(rng.choice(tokens) + " " + rng.choice(noise) for _ in range(15)) for _ in range(500)]
    for text, got in zip(texts, sane(spark, texts, links="keep"), strict=True):
        at = 0
        for word in text.split():
            if word in tokens and word not in ("U.S.", '{"k":'):
                at = got.find(word, at)
                assert at >= 0, (word, text, got)
                at += len(word)
        assert text.count('{"k": "v..w", "n": {"m": [1,2]}}') == got.count('{"k": "v..w", "n": {"m": [1,2]}}')
        assert not any(x in got for x in ("  ", "\n\n\n", "\x07", "\u200b", "“", "。", "<b>"))
