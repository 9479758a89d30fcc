"""Queries over chunk plans, nested JSON and streams, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import chunk, detect
from quire.plans.chapter_queries import HEADER_SQL, NORMAL_SQL
from quire.plans.stimulus import documents, novels
from quire.sources import readers
from quire.sources.json_text import unwrap_json
from quire.streaming import ingest, jobs


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text")


_BARE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]+"


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.plan(_texts(spark, sf_dir)).select("doc_id", "ord", "chars", "strategy", "hard_split", "error", F.sha2("text", 256).alias("sha"))


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that fill pages, and how full they are, by source."""
    budget = chunk.PageBudget()
    made = chunk.plan(documents(spark, sf_dir).select("doc_id", "source", "text"), budget=budget)
    return chunk.fill_statistics(made, budget, ["source"])


def chunk_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.strategy_counts(chunk.plan(documents(spark, sf_dir).select("doc_id", "source", "text")), ["source"])


def chunk_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the chunks are the text, and the digest of what they say."""
    texts = _texts(spark, sf_dir)
    made = chunk.plan(texts)
    joined = made.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("t"), F.max("chars").alias("most"))
    told = joined.select("doc_id", F.sha2(F.regexp_replace("t", _BARE, ""), 256).alias("sha"), (F.col("most") <= chunk.SOFT).alias("within"))
    return chunk.integrity(texts, made).join(told, "doc_id")


def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of canonical chapters: what they say by chapter, and their numbering."""
    chapters = detect.normalize(novels(spark, sf_dir))
    made = chunk.plan_chapters(chapters, with_header=True)
    own = made.groupBy("source", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("t"), F.max("parts").alias("parts"), F.count(F.lit(1)).alias("n"), F.max("part").alias("last"), F.first("chapter_title").alias("title"))
    return own.select("source", "number", F.sha2(F.regexp_replace("t", _BARE, ""), 256).alias("sha"), ((F.col("parts") == F.col("n")) & (F.col("last") == F.col("n"))).alias("numbered"), "title")


def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and clauses of texts without technical tokens."""
    bare = F.regexp_replace(F.replace("text", F.lit(". "), F.lit("! ")), r"[^\p{L} ,!?\n]", " ")
    texts = documents(spark, sf_dir).select("doc_id", bare.alias("text")).filter("length(text) > 0")
    every = chunk.split_units(texts).withColumn("kind", F.lit("sentence")).unionByName(chunk.split_units(texts, kind="clause").withColumn("kind", F.lit("clause")))
    return every.select("doc_id", "kind", "ord", "start", F.sha2("unit", 256).alias("sha"))


def protected_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical tokens put at the ends of plain texts."""
    tail = F.get(F.array(*map(F.lit, ("https://a.vn/x....y.", "www.a.vn/b,", "a.b@c.org", r"C:\\x\\y.", '{"a": {"b": "}"}}', "3.14", "12:30:05", "v1.2.3", "key:val/x", "shop.com", "TP.HCM", "U.S.A.", "Dr. No"))), (F.col("doc_id") % 13).cast("int"))
    bare = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    texts = documents(spark, sf_dir).select("doc_id", F.concat(bare, F.lit(" | "), tail).alias("text"), (F.length(bare) + 3).alias("from"))
    found = chunk.protected(texts.select("doc_id", "text")).join(texts.select("doc_id", "from"), "doc_id").filter("start >= from")
    return found.groupBy("doc_id").agg(F.max(F.struct(F.length("token").alias("n"), "token"))["token"].alias("token"))


def half_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of texts of letters and spaces only: cut at the space nearest the middle."""
    bare = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    texts = documents(spark, sf_dir).select("doc_id", bare.alias("text")).filter(~F.col("text").rlike(r"^(?i:Chapter) "))
    return chunk.halves(texts).groupBy("doc_id").agg(F.max(F.when(F.col("ord") == 0, F.length("unit"))).cast("long").alias("first_chars"), F.sum(F.length("unit")).alias("chars"))


def json_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON of several shapes: whole texts wrapped and unwrapped again."""
    own = F.struct(F.concat(F.lit("T "), "lang").alias("title"), F.col("doc_id").alias("stt"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("tiếng_việt"), F.when(F.col("doc_id") % 2 == 1, F.col("text")).alias("body"), F.lit("zzz").alias("raw"))
    kind = F.col("doc_id") % 4
    body = F.when(kind == 0, F.to_json(own)).when(kind == 1, F.to_json(F.struct(F.struct(F.lit("m").alias("k")).alias("info"), F.array(own, F.struct(F.lit("").alias("title"), F.lit(None).cast("long").alias("stt"), F.lit(None).cast("string").alias("tiếng_việt"), F.lit("Chương 2 hai").alias("body"), F.lit(None).cast("string").alias("raw"))).alias("chapters"))))
    body = body.when(kind == 2, F.concat(F.to_json(F.struct(F.array(F.col("text"), F.lit("two")).alias("data"))), F.lit(" junk"))).otherwise(F.col("text"))
    rows = documents(spark, sf_dir).select("doc_id", body.alias("json"))
    made = unwrap_json(rows)
    return made.select("doc_id", F.sha2("text", 256).alias("sha"), "is_json", F.size("blocks").alias("n_blocks"), F.aggregate("artifacts", F.lit(0).cast("long"), lambda n, x: n + F.when(x["action"] == "skipped", x["chars"]).otherwise(0)).alias("skipped"))


def entry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons for which archive entries are passed over."""
    names = F.array(*map(F.lit, ("a/b.txt", "__MACOSX/x.txt", "d/._y.txt", "d/.z.txt", "README.md", "metadata.txt", "x.pdf", "dir/", "Ch 1.TXT", "log.log")))
    rows = documents(spark, sf_dir).select("doc_id", F.get(names, (F.col("doc_id") % 10).cast("int")).alias("name"))
    return rows.groupBy("name").agg(F.first(readers.skip_reason(F.col("name"))).alias("reason"), F.count(F.lit(1)).alias("n"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.window_counts(_events(spark, sf_dir))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts by a stream over the table's files, in complete mode."""
    out = ingest.run_to_memory(ingest.window_counts(ingest.event_stream(spark, sf_dir)), f"counts_{uuid.uuid4().hex}")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.user_sessions(_events(spark, sf_dir))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("most"))


def revision_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of states: of each user the first in full, then only changes of the revision."""
    states = jobs.state_stream(ingest.event_stream(spark, sf_dir))
    return ingest.run_to_table(jobs.updates(states, "user_id", "at", "revision"), "updates").filter("kind <> 'heartbeat'")


def distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ingest.first_seen(events.select("user_id", "event_type"), ["user_id", "event_type"])


QUERIES = {f.__name__: f for f in (chunk_plan, chunk_pages, chunk_strategies, chunk_integrity, chapter_chunks, sentence_units, protected_tokens, half_splits, json_unwrap, entry_filter, window_counts, stream_ingest_counts, user_sessions, revision_updates, distinct_events)}

_DAYS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"
ORACLES = {
    "chunk_integrity": "SELECT doc_id, true AS lossless, true AS within, sha256(regexp_replace(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B\\x1C-\\x1F]+', '', 'g')) AS sha FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]')",
    "chapter_chunks": f"WITH {NORMAL_SQL}, h AS (SELECT source, number, {HEADER_SQL} AS header, text, title FROM ranked WHERE rank = 1) SELECT source, number, sha256(regexp_replace(header || CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN text ELSE '' END, '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x0B\\x1C-\\x1F]+', '', 'g')) AS sha, true AS numbered, CASE WHEN trim(title) = '' THEN header ELSE trim(title) END AS title FROM h",
    "sentence_units": r"""WITH b AS (SELECT doc_id, regexp_replace(replace(text, '. ', '! '), '[^\p{L} ,!?\n]', ' ', 'g') AS t FROM documents WHERE length(text) > 0),
 u AS (SELECT doc_id, 'sentence' AS kind, unnest(regexp_extract_all(t, '[^!?]*[!?]+|[^!?]+')) AS unit, generate_subscripts(regexp_extract_all(t, '[^!?]*[!?]+|[^!?]+'), 1) - 1 AS ord FROM b UNION ALL SELECT doc_id, 'clause', unnest(regexp_extract_all(t, '[^,]*,+|[^,]+')), generate_subscripts(regexp_extract_all(t, '[^,]*,+|[^,]+'), 1) - 1 FROM b)
 SELECT doc_id, kind, ord, CAST(coalesce(sum(length(unit)) OVER (PARTITION BY doc_id, kind ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, sha256(unit) AS sha FROM u""",
    "protected_tokens": r"""SELECT doc_id, token FROM documents JOIN (VALUES (0, 'https://a.vn/x....y'), (1, 'www.a.vn/b'), (2, 'a.b@c.org'), (3, 'C:\\x\\y'), (4, '{"a": {"b": "}"}}'), (5, '3.14'), (6, '12:30:05'), (7, 'v1.2.3'), (8, 'key:val/x'), (9, 'shop.com'), (10, 'TP.HCM'), (11, 'U.S.A.'), (12, 'Dr.')) v(k, token) ON doc_id % 13 = k""",
    "half_splits": """WITH b AS (SELECT doc_id, trim(regexp_replace(text, '[^\\p{L}]+', ' ', 'g')) AS t FROM documents), c AS (SELECT doc_id, t, length(t) AS n, list_filter(range(1, length(t)), lambda i: substring(t, i + 1, 1) = ' ') AS cuts FROM b WHERE NOT regexp_matches(t, '^(?i:Chapter) '))
 SELECT doc_id, CASE WHEN n < 2 THEN n WHEN len(cuts) = 0 THEN greatest(1, n // 2) ELSE list_min(list_filter(cuts, lambda i: abs(i - n // 2) = list_min(list_transform(cuts, lambda j: abs(j - n // 2))))) END AS first_chars, CASE WHEN n < 2 OR len(cuts) = 0 THEN n ELSE n - 1 END AS chars FROM c""",
    "json_unwrap": """WITH t AS (SELECT *, doc_id % 4 AS k, regexp_replace(text, '^\\n+|\\n+$', '', 'g') AS bare, CASE WHEN regexp_matches(text, '^\\s*(?i:Chương|Chuong|Hồi|Hoi|Quyển|Quyen|Phần|Phan|Chapter|Chap|第)') THEN '' ELSE 'Chương ' || doc_id || ': T ' || lang || chr(10) END AS head FROM documents),
 w AS (SELECT doc_id, k, text, rtrim(head || CASE WHEN head = '' THEN bare ELSE text END, chr(10)) AS one, bare FROM t)
 SELECT doc_id, sha256(CASE k WHEN 0 THEN one WHEN 1 THEN one || chr(10) || chr(10) || 'Chương 2 hai' WHEN 2 THEN bare || chr(10) || chr(10) || 'two' ELSE text END) AS sha, k < 3 AS is_json, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS n_blocks, CASE WHEN k < 2 THEN 3 ELSE 0 END AS skipped FROM w""",
    "entry_filter": "SELECT name, reason, count(*) AS n FROM documents JOIN (VALUES (0, 'a/b.txt', NULL), (1, '__MACOSX/x.txt', 'archive metadata'), (2, 'd/._y.txt', 'archive metadata'), (3, 'd/.z.txt', 'hidden'), (4, 'README.md', 'readme or metadata'), (5, 'metadata.txt', 'readme or metadata'), (6, 'x.pdf', 'suffix'), (7, 'dir/', 'directory'), (8, 'Ch 1.TXT', NULL), (9, 'log.log', NULL)) t(i, name, reason) ON doc_id % 10 = i GROUP BY name, reason",
    "window_counts": _DAYS,
    "stream_ingest_counts": _DAYS,
    "revision_updates": "SELECT user_id, CASE WHEN before IS NULL THEN 'full' ELSE 'update' END AS kind, event_id AS at, event_type AS revision FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type",
    "distinct_events": "SELECT DISTINCT user_id, event_type FROM events",
    "user_sessions": "WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, count(*) AS sessions, max(n) AS most FROM c GROUP BY user_id",
}
