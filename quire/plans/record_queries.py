"""Queries over chapter and chunk rows, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.operators import parts, records
from quire.plans.stimulus import documents
from quire.sources import sinks


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces of 700 code points: doc_id, source, number, ord, text, hard_split."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / 700).cast("int")), lambda i: F.substring(F.col("text"), i * 700 + 1, F.lit(700)))
    rows = documents(spark, sf_dir).filter("length(text) > 0").select("doc_id", "source", (F.col("doc_id") % 40 + 1).alias("number"), F.posexplode(pieces).alias("ord", "text"))
    return rows.withColumn("ord", F.col("ord").cast("long")).withColumn("hard_split", F.length("text") == 700)


CHUNKS_SQL = """chunks AS (SELECT doc_id, source, doc_id % 40 + 1 AS number, i AS ord, substring(text, CAST(i * 700 + 1 AS BIGINT), 700) AS text, length(substring(text, CAST(i * 700 + 1 AS BIGINT), 700)) = 700 AS hard_split
 FROM (SELECT *, unnest(range(CAST((greatest(length(text), 1) - 1) // 700 AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0))"""
RANGES = "1-5, 9, x, 20-12, 30-33"


def parse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("doc_id").cast("string"), F.lit("-"), (F.col("doc_id") + 5).cast("string"), F.lit(", 9, x, 20-12, 30 – 33, 30- 33"))
    return documents(spark, sf_dir).select("doc_id", F.explode(records.range_column(text)).alias("r")).select("doc_id", "r.low", "r.high")


def filter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = records.in_ranges(_chunks(spark, sf_dir), records.parse_ranges(RANGES))
    return kept.groupBy("number").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


def range_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = documents(spark, sf_dir).groupBy("source").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return records.blocks(ends, 100)


def renumber_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.renumber(_turns(spark, sf_dir), ["turn", "role", "text"], "conv_id", "turn").select("conv_id", "turn", "renumbered", "changed")


def renumber_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.renumber(_chunks(spark, sf_dir), ["number", "doc_id", "ord"], "source", "ord")
    return out.groupBy("source").agg(F.max("renumbered").alias("last"), F.sum("changed").alias("changed"))


def repair_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.with_parts(_chunks(spark, sf_dir), ["source", "number"]).select("doc_id", "ord", "parts")


def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parts.digests(records.merge_texts(documents(spark, sf_dir), "doc_id"), ["source"])
    return out.select("source", "chars", F.col("sha256").alias("sha"))


def insert_headers_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("lang").alias("grp"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 7 == 3, F.col("doc_id") % 500).alias("number"))
    return records.insert_headers(rows)


def explicit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    rows = documents(spark, sf_dir).select(F.col("source").alias("grp"), name.alias("name"), F.col("doc_id").alias("ord"))
    wanted = rows.filter("ord % 5 = 2").select("grp", "name", (-F.col("ord")).alias("pos"))
    return records.explicit_order(rows, wanted).select("grp", "name", "position")


def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.chunk_statistics(_chunks(spark, sf_dir), ["source", "number"])


def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.chunk_statistics(_chunks(spark, sf_dir), [])


def chunk_title_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the title of their chapter, or their own where the chapter has none."""
    titles = documents(spark, sf_dir).filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"))
    joined = _chunks(spark, sf_dir).join(titles, "doc_id", "left").withColumn("title", F.coalesce("title", F.concat(F.lit("own "), F.col("source"))))
    return joined.groupBy("title").agg(F.count(F.lit(1)).alias("chunks"))


def counter_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = F.create_map(F.lit("commas"), F.length("text") - F.length(F.replace("text", F.lit(","))), F.lit("lines"), F.size(F.split("text", "\n")), F.lit("docs"), F.lit(1))
    return records.counter_merge(documents(spark, sf_dir).select("source", counters.alias("m")), "m", ["source"])


def chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.fingerprint(documents(spark, sf_dir), "doc_id")


def source_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct values by key."""
    return documents(spark, sf_dir).groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


def resume_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = documents(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    done = items.filter("doc_id % 3 <> 0").withColumn("sha", F.when(F.col("doc_id") % 5 == 0, F.lit("changed")).otherwise(F.col("sha")))
    return records.worklist(items, done, ["doc_id", "source", "sha"])


def apply_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = documents(spark, sf_dir).select("doc_id", "text")
    edits = plan.filter("doc_id % 11 = 4").select("doc_id", F.upper("text").alias("text"))
    return records.apply_overrides(plan, edits, ["doc_id"]).select("doc_id", "edited", F.length("text").cast("long").alias("chars"))


def validate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"))
    listed = every.filter("doc_id % 4 <> 0").withColumn("sha", F.when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("sha")))
    return records.validate_manifest(listed, every.filter("doc_id % 6 <> 1"), ["doc_id"])


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("source", "doc_id", (F.col("doc_id") % 3).alias("revision"))
    return records.latest_revision(rows, ["source"])


def deleted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source")
    return records.without_tombstones(rows, rows.filter("doc_id % 10 < 3").select("doc_id"), ["doc_id"])


def page_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.length("text") % 97).cast("decimal(18,9)") / F.lit(7).cast("decimal(18,0)")
    rows = _turns(spark, sf_dir).groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    out = records.timeline(rows, "conv_id", "turn", F.round(seconds, 9))
    return out.select("conv_id", "turn", "start_us", "end_us")


def export_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).withColumn("title", F.concat(F.lit("C"), (F.col("ord") / 2).cast("long").cast("string")))
    return sinks.chunk_text(chunks).select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha"))


def export_range_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.range_manifest(_chunks(spark, sf_dir), 10)


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).withColumn("title", F.col("source"))
    made = sinks.chunk_json(chunks)
    return made.select("doc_id", F.get_json_object("json", "$.chunks").cast("long").alias("chunks"), F.get_json_object("json", "$.characters").cast("long").alias("characters"), F.sha2(F.get_json_object("json", "$.items[0].text"), 256).alias("first_sha"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of nested JSON by event type."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def turn_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose role differs from the one before, by conversation."""
    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = _turns(spark, sf_dir).withColumn("change", (F.col("role") != F.coalesce(before, F.lit(""))).cast("long"))
    return rows.groupBy("conv_id").agg(F.sum("change").alias("changes"), F.count(F.lit(1)).alias("turns"))


def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """partial if a part failed, else cancelled if one was, else completed."""
    rows = documents(spark, sf_dir).select("source", F.when(F.col("doc_id") % 97 == 5, "failed").when(F.col("doc_id") % 53 == 7, "cancelled").otherwise("done").alias("s"))
    status = F.when(F.bool_or(F.col("s") == "failed"), "partial").when(F.bool_or(F.col("s") == "cancelled"), "cancelled").otherwise("completed")
    return rows.groupBy("source").agg(status.alias("status"), F.count_if(F.col("s") == "done").alias("done"))


QUERIES = {f.__name__: f for f in (parse_ranges, filter_ranges, range_blocks, renumber_turns, renumber_chunks, repair_parts, merge_sources, insert_headers_even, explicit_order, chunk_statistics, document_summary, chunk_title_join, counter_map_merge, chunk_fingerprints, source_encodings, resume_worklist, apply_overrides, validate_manifest, latest_revision, deleted_groups, page_timeline, export_txt, export_range_manifest, export_json, event_props, turn_changes, batch_status)}

_STATS = "count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(length(text)) // count(*) AS BIGINT) AS mean_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, CAST(sum(CAST(hard_split AS INT)) AS BIGINT) AS hard_splits"
ORACLES = {
    "parse_ranges": "SELECT doc_id, low, high FROM documents, LATERAL (VALUES (doc_id, doc_id + 5), (9, 9), (30, 33)) t(low, high)",
    "filter_ranges": f"WITH {CHUNKS_SQL} SELECT number, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks WHERE number BETWEEN 1 AND 5 OR number = 9 OR number BETWEEN 30 AND 33 GROUP BY number",
    "range_blocks": "SELECT source, low, least(low + 99, last) AS high FROM (SELECT source, last, unnest(generate_series(first, last, 100)) AS low FROM (SELECT source, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY source))",
    "renumber_turns": "SELECT conv_id, turn, renumbered, CAST(turn <> renumbered AS BIGINT) AS changed FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS renumbered FROM conversations)",
    "renumber_chunks": f"WITH {CHUNKS_SQL} SELECT source, max(r) AS last, CAST(sum(CAST(ord <> r AS INT)) AS BIGINT) AS changed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY number, doc_id, ord) AS r FROM chunks) GROUP BY source",
    "repair_parts": f"WITH {CHUNKS_SQL} SELECT doc_id, ord, count(*) OVER (PARTITION BY source, number) AS parts FROM chunks",
    "merge_sources": r"SELECT source, length(t) AS chars, sha256(t) AS sha FROM (SELECT source, string_agg(regexp_replace(text, '\A\n+|\n+\z', '', 'g'), chr(10) || chr(10) ORDER BY doc_id) FILTER (WHERE trim(text) <> '') AS t FROM documents GROUP BY source)",
    "insert_headers_even": "WITH s AS (SELECT lang AS grp, doc_id AS ord, CASE WHEN doc_id % 7 = 3 THEN doc_id % 500 END AS number FROM documents), r AS (SELECT *, count(number) OVER o AS run, last_value(number IGNORE NULLS) OVER o AS base FROM s WINDOW o AS (PARTITION BY grp ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT grp, ord, number, CASE WHEN number IS NOT NULL THEN number ELSE coalesce(base, 0) + row_number() OVER (PARTITION BY grp, run ORDER BY ord) - CASE WHEN run > 0 THEN 1 ELSE 0 END END AS assigned FROM r",
    "explicit_order": "WITH s AS (SELECT source AS grp, 'f' || doc_id AS name, doc_id AS ord, CASE WHEN doc_id % 5 = 2 THEN -doc_id END AS pos FROM documents) SELECT grp, name, row_number() OVER (PARTITION BY grp ORDER BY pos ASC NULLS LAST, ord) AS position FROM s",
    "chunk_statistics": f"WITH {CHUNKS_SQL} SELECT source, number, {_STATS} FROM chunks GROUP BY source, number",
    "document_summary": f"WITH {CHUNKS_SQL} SELECT {_STATS} FROM chunks",
    "chunk_title_join": f"WITH {CHUNKS_SQL} SELECT CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id ELSE 'own ' || source END AS title, count(*) AS chunks FROM chunks GROUP BY 1",
    "counter_map_merge": "SELECT source, counter, CAST(sum(n) AS BIGINT) AS n FROM (SELECT source, 'commas' AS counter, length(text) - length(replace(text, ',', '')) AS n FROM documents UNION ALL SELECT source, 'lines', len(string_split(text, chr(10))) FROM documents UNION ALL SELECT source, 'docs', 1 FROM documents) GROUP BY source, counter",
    "chunk_fingerprints": "SELECT source, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source",
    "source_encodings": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source",
    "resume_worklist": "SELECT doc_id, source, sha256(text) AS sha FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0",
    "apply_overrides": "SELECT doc_id, doc_id % 11 = 4 AS edited, length(CASE WHEN doc_id % 11 = 4 THEN upper(replace(text, 'ß', 'SS')) ELSE text END) AS chars FROM documents",
    "validate_manifest": "SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'missing' WHEN doc_id % 4 = 0 THEN 'unlisted' WHEN doc_id % 9 = 0 THEN 'stale' ELSE 'valid' END AS state FROM documents WHERE NOT (doc_id % 6 = 1 AND doc_id % 4 = 0)",
    "latest_revision": "SELECT source, doc_id, revision FROM (SELECT source, doc_id, doc_id % 3 AS revision, max(doc_id % 3) OVER (PARTITION BY source) AS m FROM documents) WHERE revision = m",
    "deleted_groups": "SELECT doc_id, source FROM documents WHERE doc_id % 10 >= 3",
    "page_timeline": "WITH t AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn), e AS (SELECT conv_id, turn, CAST(round(1000000 * sum(CAST(round(CAST(length(text) % 97 AS DOUBLE) / 7, 9) AS DECIMAL(29,9))) OVER (PARTITION BY conv_id ORDER BY turn)) AS BIGINT) AS end_us FROM t) SELECT conv_id, turn, coalesce(lag(end_us) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS start_us, end_us FROM e",
    "export_txt": f"WITH {CHUNKS_SQL} SELECT doc_id, length(t) AS chars, sha256(t) AS sha FROM (SELECT doc_id, string_agg(CASE WHEN ord % 2 = 0 THEN '=== C' || (ord // 2) || ' ===' || chr(10) || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY ord) AS t FROM chunks GROUP BY doc_id)",
    "export_range_manifest": f"WITH {CHUNKS_SQL} SELECT source, (number - 1) // 10 * 10 + 1 AS range_start, (number - 1) // 10 * 10 + 10 AS range_end, count(*) AS chunks, count(DISTINCT number) AS chapters, CAST(sum(length(text)) AS BIGINT) AS characters FROM chunks GROUP BY 1, 2, 3",
    "export_json": f"WITH {CHUNKS_SQL} SELECT doc_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS characters, sha256(arg_min(text, ord)) AS first_sha FROM chunks GROUP BY doc_id",
    "event_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "turn_changes": "SELECT conv_id, CAST(sum(CAST(role <> coalesce(before, '') AS INT)) AS BIGINT) AS changes, count(*) AS turns FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) GROUP BY conv_id",
    "batch_status": "SELECT source, CASE WHEN bool_or(doc_id % 97 = 5) THEN 'partial' WHEN bool_or(doc_id % 53 = 7) THEN 'cancelled' ELSE 'completed' END AS status, count(*) FILTER (WHERE doc_id % 97 <> 5 AND doc_id % 53 <> 7) AS done FROM documents GROUP BY source",
}
