"""Prefix scans, ordered parts and interval sets against windows and plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.operators import detect, parts, records
from quire.operators.scan import Ranges
from quire.sources import sinks


def table(spark, kind, seed):
    """(k, o, v, x): one key, a hot one among others, or many; some keys and values are null."""
    rng = random.Random(seed)
    rows = []
    for i in range(700):
        key = {"one": "a", "hot": "a" if i % 3 else rng.choice("bcde"), "many": rng.choice([None, *map(str, range(150))])}[kind]
        rows.append((key, i, rng.choice([None, rng.randint(-5, 30)]), rng.choice(["", "p", "qq"])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, o int, v long, x string").repartition(5)


@pytest.mark.parametrize("kind", ["one", "hot", "many"])
@pytest.mark.parametrize("ranges", [1, 7])
def test_scan_is_a_window(spark, kind, ranges):
    rows = table(spark, kind, ranges)
    scan = Ranges(rows, ["k"], ["o"], ranges).number("nth").running("sum", F.col("v")).greatest("top", F.col("v"))
    got = scan.last("last", F.when(F.col("v").isNotNull(), F.struct("v", "sum"))).before("prev", F.col("v")).rows()
    by = W.partitionBy("k").orderBy("o")
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    want = rows.withColumn("nth", F.row_number().over(by)).withColumn("sum", F.coalesce(F.sum("v").over(upto), F.lit(0))).withColumn("top", F.max("v").over(upto))
    want = want.withColumn("last", F.last(F.when(F.col("v").isNotNull(), F.struct("v", "sum")), True).over(upto)).withColumn("prev", F.lag("v").over(by))
    key = lambda r: (r.k or "", r.o)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert len({key(r) for r in got.collect()}) == 700


def test_a_key_is_spread_over_ranges(spark):
    scan = Ranges(table(spark, "one", 3), ["k"], ["o"], 8)
    sizes = sorted(r["count"] for r in scan._rows.groupBy("_range").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    assert Ranges(table(spark, "one", 3).filter("false"), ["k"], ["o"], 4).number("n").before("b", F.col("v")).rows().collect() == []


def test_scan_without_a_key(spark):
    got = Ranges(table(spark, "hot", 1), [], ["o"], 5).number("n").rows().collect()
    assert all(r.n == r.o + 1 for r in got)


def whole(made, keys):
    out = {}
    for r in sorted(made.collect(), key=lambda r: r.part):
        out[tuple(r[k] for k in keys)] = out.get(tuple(r[k] for k in keys), "") + r.text
    return out


@pytest.mark.parametrize("size", [5, 10_000])
def test_parts_make_up_the_whole(spark, size):
    rows = table(spark, "hot", 2).withColumn("x", F.when(F.col("o") % 11 == 3, None).otherwise(F.concat(F.col("x"), F.when(F.col("o") % 4 == 0, F.lit(" \n")).otherwise(""))))
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        if r.x is not None:
            want.setdefault((r.k,), []).append(r.x)
    plain = parts.ordered_parts(rows, ["k"], ["o"], F.col("x"), between="-", size=size)
    assert whole(plain, ["k"]) == {k: "-".join(v) for k, v in want.items()}
    closed = parts.ordered_parts(rows, ["k"], ["o"], F.col("x"), end="!\n", size=size)
    assert whole(closed, ["k"]) == {k: "".join(v).rstrip() + "!\n" for k, v in want.items()}
    if size == 5:
        assert max(len(r.text) for r in plain.collect()) <= 5 + 5 and plain.count() > 50
    got = {r.k: (r.chars, r.sha256) for r in parts.digests(plain, ["k"]).collect()}
    assert got == {k: (len(t), hashlib.sha256(t.encode()).hexdigest()) for (k,), t in whole(plain, ["k"]).items()}


def test_blank_wholes_and_trees(spark):
    rows = spark.createDataFrame([("a", 1, " "), ("a", 2, "\n"), ("b", 1, None), (None, 1, "x "), (None, 2, "  ")], "k string, o int, x string")
    assert whole(parts.ordered_parts(rows, ["k"], ["o"], F.col("x"), end="\n"), ["k"]) == {("a",): "\n", (None,): "x\n"}
    made = spark.createDataFrame([(k, i, f"{k}{i}") for k in "ab" for i in range(30 if k == "a" else 2)], "k string, part long, text string")
    trees = {r.k: r for r in parts.tree_digests(made, ["k"], fan=3).collect()}
    other = {r.k: r for r in parts.tree_digests(made.withColumn("text", F.when(F.col("text") == "a17", "?").otherwise(F.col("text"))), ["k"], fan=3).collect()}
    assert trees["a"].parts == 30 and trees["b"].tree_sha256 == other["b"].tree_sha256 and trees["a"].tree_sha256 != other["a"].tree_sha256
    assert parts.tree_digests(made.filter("false"), ["k"]).collect() == []


def test_files_are_written_part_by_part(spark, tmp_path):
    rows = spark.createDataFrame([(f"d/{k}.txt", i, f"{k}é{i}\n" * 50) for k in "abc" for i in range(20)], "filename string, part long, text string").repartition(7)
    told = {r.filename: r for r in parts.write_parts(rows, str(tmp_path)).collect()}
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["a.txt", "b.txt", "c.txt"]
    for k in "abc":
        data = (tmp_path / "d" / f"{k}.txt").read_bytes()
        assert data.decode() == "".join(f"{k}é{i}\n" * 50 for i in range(20))
        assert (told[f"d/{k}.txt"].bytes, told[f"d/{k}.txt"].sha256) == (len(data), hashlib.sha256(data).hexdigest())


def test_range_files_are_json(spark):
    import json

    rows = [("s", n, o, f'T"{n}', f"text\\ {n} {o}\n") for n in (1, 2, 2, 5) for o in (n * 10, n * 10 + 1)]
    chunks = spark.createDataFrame(rows, "source string, number long, ord long, title string, text string").distinct()
    files = {r.filename: r.content for r in sinks.whole_files(sinks.range_files(chunks, [(1, 2), (4, 9), (7, 8)])).collect()}
    assert sorted(files) == ["1-2.json", "4-9.json", "manifest.json"]
    first = json.loads(files["1-2.json"])
    assert first["range"] == "1-2" and first["chunk_count"] == 4 and first["chapter_count"] == 2
    assert [(c["number"], c["ord"]) for c in first["chunks"]] == [(1, 10), (1, 11), (2, 20), (2, 21)] and first["chunks"][0]["title"] == 'T"1'
    assert [r["index"] for r in json.loads(files["manifest.json"])["ranges"]] == [1, 2]


# ---------------------------------------------------------------- intervals


def test_ranges_are_never_counted_out(spark):
    rows = spark.createDataFrame([("a", "1-5, 3-9, 10, 12-99999999999"), ("a", "99999999998-999999999999"), ("b", "7, 7, 5-6, 9-8, x"), ("c", ""), (None, "2-3")], "k string, t string")
    got = records.merged_ranges(rows.select("k", records.range_column(F.col("t")).alias("ranges")), keys=["k"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, 10), ("a", 12, 999999999999), ("b", 5, 7), (None, 2, 3)], key=str)
    first = records.expand_ranges(rows.select("k", records.range_column(F.col("t")).alias("ranges")), keys=["k"], most=12)
    assert first.filter("k = 'a'").count() == 10 + 12
    assert [r.number for r in first.filter("k = 'b'").orderBy("number").collect()] == [5, 6, 7]
    ends = spark.createDataFrame([("a", 1, 30_000_000_000)], "source string, first long, last long")
    assert records.blocks(ends, 10_000).selectExpr("count(*)", "min(low)", "max(high)", "sum(high - low + 1)").first()[:] == (3_000_000, 1, 30_000_000_000, 30_000_000_000)
    assert [tuple(r) for r in records.blocks(spark.createDataFrame([("a", 3, 9), ("b", 5, 4)], "source string, first long, last long"), 4).collect()] == [("a", 3, 6), ("a", 7, 9)]


def test_ranges_of_many_digits():
    assert records.parse_ranges("0000000000000000000007-9, 1234567890123456789, 5") == [(7, 9), (5, 5)]


def test_one_huge_number_changes_its_own_row_only(spark):
    texts = [(f"t{i}", "\n".join(f"Chương {n}\nx" for n in (1, 2, 4, 5, 6))) for i in range(20)]
    texts.append(("far", "Chương 1\nx\nChương 2\nx\nChương 99999999999\nx"))
    df = spark.createDataFrame(texts, "source string, text string")
    spans = detect.heading_spans(df)
    told = {r.source: r for r in detect.analyze_grouping(spans, 2).collect()}
    assert [tuple(m) for m in told["far"].missing_starts] == [(3, 99999999997, 49999999998)] and told["far"].refusal == "missing_starts"
    assert told["t3"].missing_starts == [] or [tuple(m) for m in told["t3"].missing_starts] == [(3, 3, 1)]
    assert {r.source for r in detect.group_by_number(spans, 3).collect()} == {f"t{i}" for i in range(20)}
    assert detect.plan_groups(spans, 3, "numeric").count() == 40
    gaps = {r.source: tuple(r)[1:] for r in detect.sequence_gaps(detect.headers(df)).collect()}
    assert gaps["far"] == (3, 99999999998, 99999999996) and gaps["t0"] == (3, 3, 1)
    report = {r.source: r for r in detect.sequence_report(detect.headers(df).withColumnRenamed("line_index", "source_line"), missing=3).collect()}
    assert report["far"].first_missing == [3, 4, 5] and report["far"].missing == 99999999996
    assert [tuple(b) for b in report["far"].first_breaks] == [(4, 2, 99999999999, "gap")]
    assert detect.analyze_grouping(spans, 2).select(detect.listed_starts(F.col("missing_starts"), 2, 4).alias("m")).filter("size(m) = 4").first().m == [3, 5, 7, 9]


def test_reports_on_numbers_search_the_texts_once(spark, tmp_path):
    from quire.plans import registry

    texts = spark.createDataFrame([("a", "Chương 1\nx\nChương 3\nx\nChương 2\nx")], "source string, text string")
    texts.write.parquet(f"{tmp_path}/texts")
    heads = detect.headers(spark.read.parquet(f"{tmp_path}/texts")).withColumnRenamed("line_index", "source_line")
    report = detect.sequence_report(heads.withColumn("number", F.col("number") * 2))
    assert not [f for f in report.inputFiles() if "/texts/" in f]
    assert [(r.missing, r.first_missing, r.breaks) for r in report.collect()] == [(2, [3, 5], 2)]
    starts = registry.queries()["numeric_starts_missing"](spark, "/root/testdata/sf0.001")
    assert not [f for f in starts.inputFiles() if "documents" in f]
