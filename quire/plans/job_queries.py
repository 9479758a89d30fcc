"""Queries over diagnostics, groups, plans, sessions and files, with their DuckDB counterparts.

Inputs are made from the documents by expressions of doc_id, all rows of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import detect, jobs, parts, prepare, records
from quire.plans.record_queries import CHUNKS_SQL, _chunks
from quire.plans.stimulus import documents
from quire.session import persist_table
from quire.sources import sinks

STAGES = ["input", "normalize", "chunk", "speech", "video", "upload"]


def _d(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """Documents with columns by SQL expressions."""
    return documents(spark, sf_dir).selectExpr("doc_id", "source", "text", *(f"{e} AS {n}" for n, e in columns.items()))


_DIAGNOSTICS = {"stage": "element_at(array('input', 'normalize', 'chunk', 'speech', 'video', 'upload'), CAST(doc_id % 6 + 1 AS INT))", "severity": "CASE doc_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END", "code": "concat('c', CAST(doc_id % 9 AS STRING))"}
_DIAGNOSTICS_SQL = "diagnostics AS (SELECT doc_id, source, (['input', 'normalize', 'chunk', 'speech', 'video', 'upload'])[doc_id % 6 + 1] AS stage, CASE doc_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, 'c' || (doc_id % 9) AS code FROM documents)"


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.severity_counts(records.without_stage(_d(spark, sf_dir, **_DIAGNOSTICS), "video"), ["source"])


def stage_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics that a change of the chunks leaves valid."""
    return records.upto_stage(_d(spark, sf_dir, **_DIAGNOSTICS), "chunk", STAGES).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


_GROUPS = {"tts_status": "element_at(array('Completed', 'Partial', NULL, 'Cancelled'), CAST(doc_id % 4 + 1 AS INT))", "audio_there": "doc_id % 3 <> 0", "failures": "CAST(doc_id % 5 = 1 AS INT)", "video_there": "doc_id % 7 < 2", "last_error": "CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END", "video_id": "CASE WHEN doc_id % 11 < 3 THEN 'id' END", "upload_status": "CASE WHEN doc_id % 5 = 0 THEN 'sent' END"}
_GROUPS_SQL = "groups AS (SELECT doc_id, source, (['Completed', 'Partial', NULL, 'Cancelled'])[doc_id % 4 + 1] AS tts_status, doc_id % 3 <> 0 AS audio_there, CAST(doc_id % 5 = 1 AS INT) AS failures, doc_id % 7 < 2 AS video_there, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END AS last_error, CASE WHEN doc_id % 11 < 3 THEN 'id' END AS video_id, CASE WHEN doc_id % 5 = 0 THEN 'sent' END AS upload_status FROM documents)"


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stage_counts(_d(spark, sf_dir, **_GROUPS), "source")


def group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _d(spark, sf_dir, **_GROUPS)
    return rows.select(*(records.group_status(s).alias(s) for s in ("tts", "video", "upload"))).groupBy("tts", "video", "upload").agg(F.count(F.lit(1)).alias("n"))


def total_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _d(spark, sf_dir, cleaned="CASE WHEN doc_id % 4 = 0 THEN replace(text, ' ', '') END", normalized="CASE WHEN doc_id % 3 = 0 THEN replace(text, ', ', ' , ') END", of_chapters="CASE WHEN doc_id % 2 = 0 THEN length(text) + 7 END")
    return rows.select("doc_id", records.total_characters(F.col("cleaned"), F.col("normalized"), F.col("of_chapters"), F.col("text")).alias("chars"))


def chapter_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).select("source", "number", (F.col("doc_id") * 1_000_000 + F.col("ord")).alias("ord"), F.when(F.col("ord") % 5 == 1, "").otherwise(F.col("text")).alias("text"), F.concat(F.lit("own "), F.col("doc_id").cast("string")).alias("title"), "hard_split")
    titles = documents(spark, sf_dir).filter("doc_id % 3 = 0").select("source", (F.col("doc_id") % 40 + 1).alias("number"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.col("doc_id").alias("source_line"))
    return records.chapter_statistics(chunks, titles)


def range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, ("1-5, 9, x, 20-12, 30-33", " ", "x, 9-1", "7", "3 - 4;5"))), (F.col("doc_id") % 5).cast("int"))
    rows = documents(spark, sf_dir).select("doc_id", text.alias("t"))
    labels = F.transform(records.range_column(F.col("t")), lambda r: F.concat_ws(":", records.range_label(r["low"], r["high"]), records.range_count(r["low"], r["high"]).cast("string")))
    return rows.select("doc_id", records.range_error(F.col("t")).alias("error"), F.array_join(labels, " ").alias("labels"))


def range_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("doc_id") % 30).cast("string"), F.lit("-"), (F.col("doc_id") % 30 + 4).cast("string"), F.lit(",7"))
    rows = documents(spark, sf_dir).select("source", records.range_column(text).alias("ranges"))
    return records.expand_ranges(rows, keys=["source"])


def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a source as a union, some of many digits."""
    low = F.col("doc_id") * 7 % 1000
    text = F.concat(low.cast("string"), F.lit("-"), (low + F.col("doc_id") % 6).cast("string"), F.when(F.col("doc_id") % 50 == 3, F.concat(F.lit(", 5000-"), (99_999_990_000 + F.col("doc_id")).cast("string"))).otherwise(""))
    rows = documents(spark, sf_dir).select("source", records.range_column(text).alias("ranges"))
    return records.merged_ranges(rows, keys=["source"]).select("*", records.range_count(F.col("low"), F.col("high")).alias("n"))


def insert_headers_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers put into headless texts, numbered on from the last headed one and (plain) from 1; blank texts get none."""
    rows = documents(spark, sf_dir).select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 7 == 3, F.col("doc_id") % 500).alias("number"), F.when(F.col("doc_id") % 13 == 5, "  ").otherwise(F.col("text")).alias("text"))
    plain = records.insert_headers(rows, continuous=False).select("ord", F.col("assigned").alias("plain"))
    made = records.put_headers(records.insert_headers(rows), "Hồi {n}")
    return made.join(plain, "ord").select("ord", "assigned", "plain", "injected", F.sha2("text", 256).alias("sha"))


def auto_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers found in the texts themselves, the largest number of each; texts without one get one, blank ones don't."""
    made = F.expr("""CASE WHEN doc_id % 7 = 3 THEN 'Chương ' || (doc_id % 500) || chr(10) || text || chr(10) || 'Chapter ' || (doc_id % 300) WHEN doc_id % 13 = 5 THEN '  ' ELSE text END""")
    rows = documents(spark, sf_dir).select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), made.alias("text"))
    return detect.auto_headers(rows).select("ord", "number", "assigned", "injected", F.sha2("text", 256).alias("sha"))


def plan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which plans are made again: of groups whose saved plan is missing, has another digest or is of another revision."""
    id_ = F.col("doc_id").cast("string")
    groups = documents(spark, sf_dir).select("doc_id", id_.alias("source"), id_.alias("group_id"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), F.col("text").alias("slice"), F.sha2("text", 256).alias("text_sha256"), (F.col("doc_id") % 3).alias("revision"))
    spans = persist_table(detect.heading_spans(groups.select("source", F.col("slice").alias("text"))), "spans")
    number = F.col("group_id").cast("long")
    saved = prepare.prepare(groups, spans).fresh.filter(number % 4 != 0).withColumn("text", F.when((number % 5 == 2) & (F.col("ord") == 1), F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    now = groups.withColumn("revision", F.when(F.col("doc_id") % 7 == 3, 9).otherwise(F.col("revision")))
    return prepare.prepare(now, spans, saved).states.select("group_id", "state")


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each group, of those that were saved for the text it has now."""
    groups = documents(spark, sf_dir).select(F.col("doc_id").alias("group_id"), F.sha2("text", 256).alias("text_sha256"))
    state = F.when(F.col("group_id") % 5 == 1, "x").otherwise(F.col("text_sha256"))
    states = groups.filter("group_id % 3 <> 0").select("group_id", state.alias("text_sha256"), F.explode(F.array(*map(F.lit, (2, 7, 4)))).alias("at")).select("group_id", "text_sha256", "at", F.concat(F.lit("s"), F.col("at").cast("string")).alias("state"))
    return jobs.job_states(groups, states, "at").select("group_id", "state")


def newer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of sessions, or the job's own where it was saved after the session."""
    groups = documents(spark, sf_dir).select(F.col("doc_id").alias("group_id"), F.sha2("text", 256).alias("text_sha256"), (F.col("doc_id") * 10).alias("updated_at"), F.lit("session").alias("state"))
    states = groups.filter("group_id % 4 <> 1").select("group_id", "text_sha256", (F.col("updated_at") + F.col("group_id") % 3 - 1).alias("saved_at"), F.concat(F.lit("job "), F.col("group_id").cast("string")).alias("state"))
    return jobs.newer_states(groups, states).select("group_id", "state")


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 1, "?!").otherwise(F.col("text"))
    return documents(spark, sf_dir).select(F.concat(F.lit("p"), (F.col("doc_id") + F.col("doc_id") % 2 * 1_000_000).cast("string")).alias("plan_id"), F.col("doc_id").alias("ord"), text.alias("text"))


def stale_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of plans that aren't current."""
    plan = documents(spark, sf_dir).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("plan_id"))
    return jobs.stale_overrides(plan, _edits(spark, sf_dir)).select("plan_id", "ord")


def accepted_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of chunks that failed, whose texts can be spoken and aren't too long."""
    failed = _edits(spark, sf_dir).filter("ord % 4 <> 2").select("plan_id", "ord")
    return jobs.accept_edits(_edits(spark, sf_dir), failed, 2000).select("plan_id", "ord", F.sha2("text", 256).alias("sha"))


def touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are gone, new or changed since their sizes and times were noted."""
    files = documents(spark, sf_dir).select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.length("text").cast("long").alias("size"), F.col("doc_id").alias("modified"))
    now = files.filter("doc_id % 9 <> 4").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 5 == 3, 1).otherwise(0)).withColumn("modified", F.col("modified") + F.when(F.col("doc_id") % 7 == 2, 1).otherwise(0))
    return jobs.touched(files.filter("doc_id % 8 <> 6"), now)


def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit order that names some sources by name and others by path."""
    rows = documents(spark, sf_dir).select(F.col("source").alias("grp"), F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("name"), F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("ord"))
    named = rows.filter("ord % 5 = 2").select("grp", "name", (-F.col("ord")).alias("pos"))
    placed = rows.filter("ord % 9 = 4").select("grp", F.col("path").alias("name"), F.col("ord").alias("pos"))
    return records.explicit_order(rows, named.unionByName(placed)).select("grp", "path", "position")


def first_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("source", (F.col("doc_id") % 40).alias("number"), "doc_id")
    return records.first_of(rows, ["source", "number"], "doc_id")


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log of 20 rows a source holds, after a sequence number."""
    return records.rows_after(records.last_rows(documents(spark, sf_dir).select("source", "doc_id"), 20, "doc_id", "source"), "doc_id", 30)


def revision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("source", "doc_id", F.floor(F.col("doc_id") / 60).alias("revision"))
    return jobs.changes(rows, "source", "doc_id")


def selection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    chosen = rows.select("source", (F.col("doc_id") - F.when(F.col("source").rlike("3$"), F.col("doc_id") % 40).otherwise(0)).alias("item"))
    return records.selection_errors(chosen, rows.filter("NOT source LIKE '%7'").select("source", F.col("doc_id").alias("item")), "source", "item")


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("source", F.concat(F.lit("f"), (F.col("doc_id") % 700).cast("string")).alias("path"), F.col("doc_id").alias("o"))
    there = rows.filter("o % 3 = 0").select("path")
    return records.missing_files(rows, there, "source", "o")


def map_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("source"), F.lit("k"), F.lit("kept"))
    over = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("b"), F.col("doc_id").cast("string"), F.lit("k"), F.lit("lost"), F.lit("z"), F.lit("2")))
    made = records.overlay(base, over, ["k"])
    return documents(spark, sf_dir).select("doc_id", made.alias("m")).select("doc_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in "abkz"), F.size("m").alias("n"))


def upload_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda *kv: F.create_map(*map(F.lit, kv))
    shared = F.when(F.col("doc_id") % 2 == 0, m("title", "shared", "privacy", "private")).otherwise(m("privacy", "public"))
    own = F.when(F.col("doc_id") % 5 == 0, m("title", "own")).when(F.col("doc_id") % 5 == 1, m("privacy", "unlisted"))
    made = records.upload_metadata(shared, own, F.when(F.col("doc_id") % 3 == 0, "of group"), F.col("source"), F.col("lang"))
    return documents(spark, sf_dir).select("doc_id", made.alias("m")).select("doc_id", F.try_element_at("m", F.lit("title")).alias("title"), F.try_element_at("m", F.lit("privacy")).alias("privacy"))


def small_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, tolerances, lengths of tags, times with a zone, and display titles, by row."""
    from quire.operators.chunk import display_title

    k = F.col("doc_id") % 6
    label = F.get(F.array(*map(F.lit, ("12", "0", "-3", "x", "7.5", "3"))), k.cast("int"))
    when = F.get(F.array(*map(F.lit, ("2026-01-02T03:04:05Z", "2026-01-02T03:04:05+07:00", "2026-01-02T03:04:05", "no", "2026-13-02T03:04:05Z", "2026-01-02 03:04+00:00"))), k.cast("int"))
    rate = F.when(k < 3, 24000).otherwise(44100)
    return documents(spark, sf_dir).select(
        "doc_id",
        records.page_label(label, F.col("source")).alias("label"),
        F.round(records.rounding_tolerance(F.when(k % 2 == 0, "mp3").otherwise("aac"), rate), 9).alias("tolerance"),
        records.tags_length(F.split(F.concat_ws(",", "source", F.lit("two words"), F.repeat(F.lit("y"), k.cast("int"))), ",")).alias("tags"),
        F.unix_timestamp(records.zoned_time(when)).alias("at"),
        display_title(F.when(k == 0, "T").when(k == 1, " ").otherwise(""), F.when(k < 3, "H").otherwise(""), F.col("doc_id")).alias("title"),
    )


def story_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by titles that differ in case, width and white space."""
    rows = documents(spark, sf_dir)
    wide = F.translate(F.upper("source"), "SRC0123456789", "ＳＲＣ０１２３４５６７８９")
    titles = rows.select("doc_id", F.concat(F.lit("  "), F.when(F.col("doc_id") % 2 == 0, wide).otherwise(F.col("source")), F.lit(" ")).alias("title"))
    saved = rows.filter("NOT source LIKE '%5'").select(F.col("source").alias("title"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("tags"), F.col("doc_id").alias("pos"))
    return records.title_tags(titles, saved).select("doc_id", "tags")


def manifest_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = documents(spark, sf_dir).select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    right = left.withColumn("sha", F.when(F.col("doc_id") % 67 == 5, F.lit("x")).otherwise(F.col("sha"))).filter("doc_id % 101 <> 3")
    return records.aligned(left, right, "doc_id", ["sha"], "source")


def narration_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their records, of the documents whose every record fits."""
    chunks = _chunks(spark, sf_dir).select("doc_id", (F.col("ord") + 1).alias("ord"), "text")
    said = chunks.filter("NOT (doc_id % 7 = 3 AND ord = 1)").withColumn("text", F.when((F.col("doc_id") % 11 == 4) & (F.col("ord") == 2), "other").otherwise(F.col("text"))).withColumn("text_sha256", F.when((F.col("doc_id") % 13 == 6) & (F.col("ord") == 1), "no").otherwise(F.sha2("text", 256)))
    return records.complete_join(chunks, said, ["doc_id", "ord"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manifest of groups, a document each, as recomputed and as it was saved."""
    now = documents(spark, sf_dir).select("source", F.col("doc_id").alias("ord"), F.lit(0).alias("start"), F.length("text").alias("end"), F.concat(F.lit("Chương "), F.col("doc_id").cast("string")).alias("label"), F.col("doc_id").cast("string").alias("range_label"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("name"), F.sha2(F.concat(F.lit("g"), F.col("doc_id").cast("string")), 256).alias("group_id"), F.sha2("source", 256).alias("source_sha256"), F.sha2("text", 256).alias("text_sha256"))
    k = F.col("ord") % 23
    saved = now.filter("ord % 41 <> 7").withColumn("label", F.when(k == 1, "x").otherwise(F.col("label"))).withColumn("text_sha256", F.when(k == 2, "x").otherwise(F.col("text_sha256"))).withColumn("group_id", F.when(k == 3, "x").otherwise(F.col("group_id")))
    return saved, now.filter("ord % 43 <> 9")


def check_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved, now = _manifest(spark, sf_dir)
    return jobs.check_manifest(saved, now, now.filter("ord % 10 = 4").select("source", "group_id")).select("source", "ord", "state")


def restorable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved, now = _manifest(spark, sf_dir)
    few = now.filter("source IN ('src1', 'src2') OR ord % 23 > 3").filter("ord % 41 <> 7")
    kept = saved.filter("source IN ('src1', 'src2') OR ord % 23 > 3").filter("ord % 43 <> 9")
    return jobs.restorable(jobs.check_manifest(kept, few, now.filter("ord % 10 = 4").select("source", "group_id")))


def delete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones, of the sources whose manifest is as it was seen."""
    saved = _manifest(spark, sf_dir)[0]
    seen = saved.filter("NOT (source LIKE '%4' AND ord % 2 = 0)")
    gone = jobs.delete_groups(saved.select("source", "ord", "group_id"), seen.select("source", "ord", "group_id"), saved.filter("ord % 6 = 1").select("source", "group_id"))
    return gone.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def reusable_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).select(F.col("doc_id").alias("group_id"), F.lit("p1").alias("plan_id"), (F.col("ord") + 1).alias("ord"), "text", F.sha2("text", 256).alias("text_sha256"))
    saved = chunks.filter("NOT (group_id % 5 = 2 AND ord = 1)").withColumn("text_sha256", F.when((F.col("group_id") % 9 == 4) & (F.col("ord") == 1), "x").otherwise(F.col("text_sha256")))
    wanted = documents(spark, sf_dir).select(F.col("doc_id").alias("group_id"), F.when(F.col("doc_id") % 4 == 0, "p2").otherwise("p1").alias("plan_id"))
    return jobs.reusable_plans(wanted, saved)


def effective_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("plan_id"), "ord", "text")
    edits = chunks.filter("ord = 0").withColumn("text", F.expr("CASE WHEN plan_id LIKE '%1' THEN '...' WHEN plan_id LIKE '%2' THEN repeat('long ', 500) WHEN plan_id LIKE '%3' THEN replace(text, 'e', 'é') ELSE text END")).withColumn("plan_id", F.expr("CASE WHEN plan_id LIKE '%4' THEN 'old' ELSE plan_id END"))
    out = jobs.effective_chunks(chunks, edits.dropDuplicates(["plan_id", "ord"]), 2000)
    return out.filter("ord = 0").select("plan_id", "edited", "error", F.length("text").cast("long").alias("chars"))


def list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved sessions, some of them spoilt, as they are listed."""
    rows = documents(spark, sf_dir).select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("id"), "source", F.struct(F.length("text").alias("chars")).alias("document"), F.struct(F.lit("vi").alias("voice")).alias("settings"), F.struct((F.col("doc_id") % 9).alias("tab")).alias("ui"))
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("doc_id") * 60)
    saved = rows.select("doc_id", "id", jobs.save_session(F.col("id"), F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("source")), F.col("document"), F.col("settings"), F.col("ui"), at).alias("json"))
    k = F.col("doc_id") % 17
    spoilt = saved.withColumn("json", F.when(k == 1, F.substring("json", 1, 50)).when(k == 2, F.replace("json", F.lit('"schema_version":1'), F.lit('"schema_version":2'))).when(k == 3, F.regexp_replace("json", '"settings":\\{[^}]*\\}', '"settings":[]')).otherwise(F.col("json"))).withColumn("id", F.when(k == 4, "x").otherwise(F.col("id")))
    return jobs.list_sessions(spoilt).select("id", "title", F.unix_timestamp("updated_at").alias("at"), "step")


def render_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as they are, empty ones too; and each by itself."""
    rows = documents(spark, sf_dir).select("source", (F.col("doc_id") % 40).alias("number"), F.col("doc_id").alias("source_line"), F.when(F.col("doc_id") % 6 == 1, "").otherwise(F.concat(F.lit("Chương "), F.col("doc_id").cast("string"))).alias("header"), F.when(F.col("doc_id") % 4 == 2, "").otherwise(F.substring("text", 1, 90)).alias("text"))
    alone = rows.groupBy("source").agg(F.sum(F.length(sinks.chapter_text(F.col("header"), F.col("text")))).alias("alone_chars"))
    return parts.digests(sinks.merged(rows), ["source"]).join(alone, "source").select("source", F.col("sha256").alias("sha"), "alone_chars")


def range_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of ranges of chapters, overlapping and empty ones among them."""
    chunks = _chunks(spark, sf_dir).select("source", "number", (F.col("doc_id") * 1_000_000 + F.col("ord")).alias("ord"), F.col("source").alias("title"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
    made = sinks.range_files(chunks, [(1, 5), (90, 99), (4, 4)], form="txt", folders=True, manifest=False)
    return parts.digests(made, ["source", "filename"]).select("source", "filename", F.col("sha256").alias("sha"))


def range_file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).select("source", "number", (F.col("doc_id") * 1_000_000 + F.col("ord")).alias("ord"), F.col("source").alias("title"), "text")
    made = sinks.range_files(chunks, [(1, 5), (90, 99), (4, 4)]).filter("filename = 'manifest.json'")
    get = lambda p: F.get_json_object("text", p)
    return made.select("source", get("$.total_ranges").cast("long").alias("total"), get("$.ranges[0].chunks").cast("long").alias("chunks"), get("$.ranges[0].characters").cast("long").alias("characters"), get("$.ranges[1].index").cast("long").alias("index"), get("$.ranges[1].filename").alias("filename"))


def detailed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _d(spark, sf_dir, **_DIAGNOSTICS).withColumn("source", F.col("doc_id").cast("string"))
    chunks = _chunks(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source"), "ord", "number", "text")
    chapters = docs.filter("doc_id % 3 <> 0").select("source", (F.col("doc_id") % 40).alias("number"), F.lit(1).alias("source_line"), F.lit("h").alias("header"))
    made = sinks.detailed_json(docs.select("source", "text"), chapters, chunks, docs.select("source", "stage", "severity", "code"))
    get = lambda p: F.get_json_object("json", p)
    return made.select(F.col("source").cast("long").alias("doc_id"), F.sha2(get("$.text"), 256).alias("text_sha"), *(get(f"$.summary.{k}").cast("long").alias(k) for k in ("chapter_count", "chunk_count", "chunk_max", "chunk_avg")), get("$.diagnostic_summary.errors").cast("long").alias("errors"), F.sha2(get("$.chunks[0].text"), 256).alias("first_sha"))


def timeline_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id", "turn").agg(F.lit(1)).select("conv_id", F.col("turn").alias("ord"), F.concat(F.lit("it's "), F.col("turn").cast("string"), F.lit(".png")).alias("file"), (F.col("turn") * 2_500_000).alias("start_us"), (F.col("turn") * 2_500_000 + 2_500_000).alias("end_us"))
    return sinks.timeline_script(pages, "conv_id").select("conv_id", F.sha2("script", 256).alias("sha"))


QUERIES = {f.__name__: f for f in (severity_counts, stage_reset, stage_counts, group_status, total_characters, chapter_statistics, range_checks, range_numbers, merged_ranges, insert_headers_text, auto_headers, plan_states, job_states, newer_states, stale_overrides, accepted_edits, touched_files, source_order, first_chapters, log_tail, revision_changes, selection_errors, missing_files, map_overlay, upload_metadata, small_values, story_tags, manifest_alignment, narration_records, check_manifest, restorable_groups, delete_groups, reusable_plans, effective_chunks, list_sessions, render_merged, range_files, range_file_manifest, detailed_json, timeline_script)}

_TTS = "CASE WHEN coalesce(tts_status = 'Completed' AND audio_there, false) THEN 'done' WHEN failures > 0 OR coalesce(tts_status IN ('Partial', 'TTS Incomplete', 'Cancelled', 'Completed'), false) THEN 'error' ELSE 'todo' END"
_STATES = """saved AS (SELECT source, doc_id AS ord, doc_id % 23 AS k FROM documents WHERE doc_id % 41 <> 7), now AS (SELECT source, doc_id AS ord FROM documents WHERE doc_id % 43 <> 9)"""
_STATE = "CASE WHEN s.ord IS NULL THEN 'missing' WHEN n.ord IS NULL THEN 'surplus' WHEN k = 1 THEN 'moved' WHEN k = 2 THEN 'stale' WHEN k = 3 THEN 'foreign' WHEN s.ord % 10 = 4 THEN 'deleted' ELSE 'current' END"
ORACLES = {
    "severity_counts": f"WITH {_DIAGNOSTICS_SQL} SELECT source, count(*) AS total, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info FROM diagnostics WHERE stage <> 'video' GROUP BY source",
    "stage_reset": f"WITH {_DIAGNOSTICS_SQL} SELECT stage, count(*) AS n FROM diagnostics WHERE stage IN ('input', 'normalize', 'chunk') GROUP BY stage",
    "stage_counts": f"WITH {_GROUPS_SQL}, c AS (SELECT source, count(*) AS total, count(*) FILTER (tts_status = 'Completed' AND audio_there) AS audio, count(*) FILTER (video_there) AS video, count(*) FILTER (video_id IS NOT NULL) AS upload FROM groups GROUP BY source) SELECT *, audio = total AS audio_done, video = total AS video_done, upload = total AS upload_done FROM c",
    "group_status": f"WITH {_GROUPS_SQL}, s AS (SELECT {_TTS} AS tts, CASE WHEN video_there THEN 'done' WHEN last_error <> '' AND coalesce(tts_status = 'Completed' AND audio_there, false) THEN 'error' ELSE 'todo' END AS video, CASE WHEN video_id IS NOT NULL THEN 'done' WHEN upload_status IS NOT NULL AND last_error <> '' THEN 'error' ELSE 'todo' END AS upload FROM groups) SELECT tts, video, upload, count(*) AS n FROM s GROUP BY ALL",
    "total_characters": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN length(replace(text, ' ', '')) WHEN doc_id % 3 = 0 THEN length(replace(text, ', ', ' , ')) WHEN doc_id % 2 = 0 THEN length(text) + 7 ELSE length(text) END AS chars FROM documents",
    "chapter_statistics": f"""WITH {CHUNKS_SQL}, c AS (SELECT source, number, doc_id * 1000000 + ord AS o, doc_id, CASE WHEN ord % 5 = 1 THEN 0 ELSE length(text) END AS n, hard_split FROM chunks),
 z AS (SELECT *, max(CASE WHEN n = 0 THEN o END) OVER (PARTITION BY source, number) AS zero FROM c),
 s AS (SELECT source, number, 'own ' || arg_min(doc_id, o) AS own, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS characters, coalesce(min(CASE WHEN zero IS NULL OR o > zero THEN n END), 0) AS min_chars, max(n) AS max_chars, CAST(sum(CAST(hard_split AS INT)) AS BIGINT) AS hard_splits FROM z GROUP BY source, number),
 t AS (SELECT source, doc_id % 40 + 1 AS number, 'T' || min(doc_id) AS title FROM documents WHERE doc_id % 3 = 0 GROUP BY 1, 2)
 SELECT s.* EXCLUDE (own), coalesce(title, own) AS title FROM s LEFT JOIN t ON s.source = t.source AND s.number = t.number""",
    "range_checks": "SELECT doc_id, error, labels FROM documents JOIN (VALUES (0, NULL, '1-5:5 9:1 30-33:4'), (1, 'empty', ''), (2, 'no_range', ''), (3, NULL, '7:1'), (4, 'no_range', '')) v(k, error, labels) ON doc_id % 5 = k",
    "range_numbers": "SELECT DISTINCT source, n AS number FROM (SELECT source, unnest(list_append(range(doc_id % 30, doc_id % 30 + 5), 7)) AS n FROM documents)",
    "merged_ranges": """WITH r AS (SELECT source, doc_id * 7 % 1000 AS low, doc_id * 7 % 1000 + doc_id % 6 AS high FROM documents UNION SELECT source, 5000, 99999990000 + doc_id FROM documents WHERE doc_id % 50 = 3),
 s AS (SELECT *, max(high) OVER (PARTITION BY source ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r), n AS (SELECT *, count(*) FILTER (top IS NULL OR low > top + 1) OVER (PARTITION BY source ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS nr FROM s)
 SELECT source, min(low) AS low, max(high) AS high, max(high) - min(low) + 1 AS n FROM n GROUP BY source, nr""",
    "insert_headers_text": """WITH s AS (SELECT source AS grp, doc_id AS ord, CASE WHEN doc_id % 7 = 3 THEN doc_id % 500 END AS number, CASE WHEN doc_id % 13 = 5 THEN '  ' ELSE text END AS text FROM documents),
 r AS (SELECT *, count(number) OVER o AS run, last_value(number IGNORE NULLS) OVER o AS base, number IS NULL AND trim(text) <> '' AS wants FROM s WINDOW o AS (PARTITION BY grp ORDER BY ord ROWS UNBOUNDED PRECEDING)),
 a AS (SELECT *, CASE WHEN number IS NOT NULL THEN number WHEN wants THEN coalesce(base, 0) + sum(CAST(wants AS INT)) OVER (PARTITION BY grp, run ORDER BY ord ROWS UNBOUNDED PRECEDING) END AS assigned, CASE WHEN number IS NOT NULL THEN number WHEN wants THEN sum(CAST(wants AS INT)) OVER (PARTITION BY grp ORDER BY ord ROWS UNBOUNDED PRECEDING) END AS plain FROM r)
 SELECT ord, CAST(assigned AS BIGINT) AS assigned, CAST(plain AS BIGINT) AS plain, number IS NULL AND assigned IS NOT NULL AS injected, sha256(CASE WHEN number IS NULL AND assigned IS NOT NULL THEN 'Hồi ' || CAST(assigned AS BIGINT) || chr(10) || regexp_replace(text, '^\\s+', '') ELSE text END) AS sha FROM a""",
    "auto_headers": """WITH s AS (SELECT source AS grp, doc_id AS ord, CASE WHEN doc_id % 7 = 3 THEN greatest(doc_id % 500, doc_id % 300) END AS number, CASE WHEN doc_id % 7 = 3 THEN 'Chương ' || (doc_id % 500) || chr(10) || text || chr(10) || 'Chapter ' || (doc_id % 300) WHEN doc_id % 13 = 5 THEN '  ' ELSE text END AS text FROM documents),
 r AS (SELECT *, count(number) OVER o AS run, last_value(number IGNORE NULLS) OVER o AS base, number IS NULL AND trim(text) <> '' AS wants FROM s WINDOW o AS (PARTITION BY grp ORDER BY ord ROWS UNBOUNDED PRECEDING)),
 a AS (SELECT *, CASE WHEN number IS NOT NULL THEN number WHEN wants THEN coalesce(base, 0) + sum(CAST(wants AS INT)) OVER (PARTITION BY grp, run ORDER BY ord ROWS UNBOUNDED PRECEDING) END AS assigned FROM r)
 SELECT ord, number, CAST(assigned AS BIGINT) AS assigned, number IS NULL AND assigned IS NOT NULL AS injected, sha256(CASE WHEN number IS NULL AND assigned IS NOT NULL THEN 'Chương ' || CAST(assigned AS BIGINT) || chr(10) || regexp_replace(text, '^\\s+', '') ELSE text END) AS sha FROM a""",
    "plan_states": "SELECT CAST(doc_id AS VARCHAR) AS group_id, CASE WHEN NOT regexp_matches(text, '[\\p{L}\\p{N}]') THEN 'failed' WHEN doc_id % 4 <> 0 AND doc_id % 5 <> 2 AND doc_id % 7 <> 3 THEN 'reused' ELSE 'fresh' END AS state FROM documents",
    "job_states": "SELECT doc_id AS group_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 1 THEN 's7' END AS state FROM documents",
    "newer_states": "SELECT doc_id AS group_id, CASE WHEN doc_id % 4 <> 1 AND doc_id % 3 = 2 THEN 'job ' || doc_id ELSE 'session' END AS state FROM documents",
    "stale_overrides": "SELECT 'p' || (doc_id + 1000000) AS plan_id, doc_id AS ord FROM documents WHERE doc_id % 2 = 1",
    "accepted_edits": "SELECT 'p' || (doc_id + doc_id % 2 * 1000000) AS plan_id, doc_id AS ord, sha256(text) AS sha FROM documents WHERE doc_id % 4 <> 2 AND doc_id % 3 <> 1 AND length(text) <= 2000 AND regexp_matches(text, '[\\p{L}\\p{N}]')",
    "touched_files": """WITH f AS (SELECT *, source || '/' || doc_id AS path, doc_id % 8 <> 6 AS a, doc_id % 9 <> 4 AS b FROM documents) SELECT path, CASE WHEN NOT b THEN 'gone' WHEN NOT a THEN 'new' ELSE 'changed' END AS change FROM f WHERE (a OR b) AND (NOT a OR NOT b OR doc_id % 5 = 3 OR doc_id % 7 = 2)""",
    "source_order": """WITH s AS (SELECT source AS grp, 'f' || (doc_id % 50) AS name, 'p/' || doc_id AS path, doc_id AS ord FROM documents), w AS (SELECT grp, name, min(-ord) AS pos FROM s WHERE ord % 5 = 2 GROUP BY grp, name),
 l AS (SELECT *, ord = max(ord) OVER (PARTITION BY grp, name) AS last FROM s), j AS (SELECT l.grp, l.path, l.ord, least(CASE WHEN last THEN w.pos END, CASE WHEN l.ord % 9 = 4 THEN l.ord END) AS pos FROM l LEFT JOIN w ON l.grp = w.grp AND l.name = w.name)
 SELECT grp, path, row_number() OVER (PARTITION BY grp ORDER BY pos ASC NULLS LAST, ord) AS position FROM j""",
    "first_chapters": "SELECT source, doc_id % 40 AS number, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2",
    "log_tail": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n <= 20 AND doc_id > 30",
    "revision_changes": "SELECT source, min(doc_id) AS doc_id, doc_id // 60 AS revision FROM documents GROUP BY source, doc_id // 60",
    "selection_errors": "WITH c AS (SELECT source, CASE WHEN source LIKE '%3' THEN doc_id - doc_id % 40 ELSE doc_id END AS item FROM documents), m AS (SELECT c.source, c.item, EXISTS (SELECT 1 FROM documents d WHERE d.source = c.source AND d.doc_id = c.item AND NOT d.source LIKE '%7') AS known FROM c), g AS (SELECT source, count(*) AS n, count(*) - count(DISTINCT item) AS repeated, count(*) FILTER (NOT known) AS unknown FROM m GROUP BY source) SELECT *, CASE WHEN repeated > 0 THEN 'repeated' WHEN unknown > 0 THEN 'unknown' END AS error FROM g",
    "missing_files": "SELECT source, 'f' || (doc_id % 700) AS path, min(doc_id) AS ord FROM documents WHERE doc_id % 700 NOT IN (SELECT doc_id % 700 FROM documents WHERE doc_id % 3 = 0) GROUP BY 1, 2",
    "map_overlay": "SELECT doc_id, '1' AS a, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE source END AS b, 'kept' AS k, CASE WHEN doc_id % 3 = 0 THEN '2' END AS z, CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 3 END AS n FROM documents",
    "upload_metadata": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'own' WHEN doc_id % 3 = 0 THEN 'of group' WHEN doc_id % 2 = 0 THEN 'shared' ELSE source || ' | ' || lang END AS title, CASE WHEN doc_id % 5 = 1 THEN 'unlisted' WHEN doc_id % 2 = 0 THEN 'private' ELSE 'public' END AS privacy FROM documents",
    "small_values": """SELECT doc_id, coalesce((['Chương 12', NULL, NULL, NULL, NULL, 'Chương 3'])[k + 1], source) AS label, round(greatest(0.002, CAST(2 * CASE WHEN k % 2 = 0 THEN CASE WHEN k < 3 THEN 576 ELSE 1152 END ELSE 1024 END AS DOUBLE) / CASE WHEN k < 3 THEN 24000 ELSE 44100 END), 9) AS tolerance,
 length(source) + 11 + k + 2 AS tags, ([1767323045, 1767297845, NULL, NULL, NULL, 1767323040])[k + 1] AS at, CASE WHEN k = 0 THEN 'T' WHEN k < 3 THEN 'H' ELSE 'Chương ' || doc_id END AS title FROM (SELECT *, doc_id % 6 AS k FROM documents)""",
    "story_tags": "SELECT d.doc_id, s.tags FROM documents d LEFT JOIN (SELECT source, 't' || min(doc_id) AS tags FROM documents WHERE NOT source LIKE '%5' GROUP BY source) s ON s.source = d.source",
    "manifest_alignment": "WITH l AS (SELECT source, sha256(text) AS sha, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), r AS (SELECT source, CASE WHEN doc_id % 67 = 5 THEN 'x' ELSE sha256(text) END AS sha, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE doc_id % 101 <> 3) SELECT source, count(l.n) AS n_left, count(r.n) AS n_right, bool_and(coalesce(l.sha = r.sha, false)) AS same FROM l FULL JOIN r USING (source, n) GROUP BY source",
    "narration_records": f"WITH {CHUNKS_SQL}, c AS (SELECT doc_id, ord + 1 AS ord, text FROM chunks) SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM c WHERE doc_id % 7 <> 3 AND doc_id % 13 <> 6 GROUP BY doc_id HAVING NOT (doc_id % 11 = 4 AND count(*) > 1)",
    "check_manifest": f"WITH {_STATES} SELECT coalesce(s.source, n.source) AS source, coalesce(s.ord, n.ord) AS ord, {_STATE} AS state FROM saved s FULL JOIN now n ON s.source = n.source AND s.ord = n.ord",
    "restorable_groups": "WITH b AS (SELECT source, doc_id AS ord, doc_id % 23 AS k FROM documents WHERE doc_id % 41 <> 7 AND doc_id % 43 <> 9 AND (source IN ('src1', 'src2') OR doc_id % 23 > 3)) SELECT source, bool_and(k NOT IN (1, 2, 3)) AS restorable, count(*) FILTER (k NOT IN (1, 2, 3) AND ord % 10 <> 4) AS active, count(*) FILTER (k NOT IN (1, 2, 3) AND ord % 10 = 4) AS deleted FROM b GROUP BY source",
    "delete_groups": "WITH s AS (SELECT source, doc_id, CASE WHEN doc_id % 23 = 3 THEN 'x' ELSE CAST(doc_id AS VARCHAR) END AS g FROM documents WHERE doc_id % 41 <> 7) SELECT source, count(DISTINCT g) AS n FROM s WHERE doc_id % 6 = 1 AND source NOT IN (SELECT source FROM s WHERE source LIKE '%4' AND doc_id % 2 = 0) GROUP BY source",
    "reusable_plans": "SELECT doc_id AS group_id, 'p1' AS plan_id FROM documents WHERE length(text) > 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 2 AND doc_id % 9 <> 4",
    "effective_chunks": f"WITH {CHUNKS_SQL} SELECT 'p' || doc_id AS plan_id, doc_id % 10 IN (1, 2) OR (doc_id % 10 = 3 AND contains(text, 'e')) AS edited, CASE WHEN doc_id % 10 IN (1, 2) THEN 'invalid' WHEN NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 'invalid' END AS error, CASE WHEN doc_id % 10 = 1 THEN 3 WHEN doc_id % 10 = 2 THEN 2500 ELSE length(text) END AS chars FROM chunks WHERE ord = 0",
    "list_sessions": "SELECT md5(CAST(doc_id AS VARCHAR)) AS id, CASE WHEN doc_id % 10 = 0 THEN 'Phiên chưa đặt tên' ELSE source END AS title, 1767225600 + doc_id * 60 AS at, least(5, doc_id % 9 + 1) AS step FROM documents WHERE doc_id % 17 NOT IN (1, 2, 3, 4)",
    "render_merged": "WITH r AS (SELECT source, doc_id % 40 AS number, doc_id, CASE WHEN doc_id % 6 = 1 THEN '' ELSE 'Chương ' || doc_id || chr(10) || chr(10) END AS head, CASE WHEN doc_id % 4 = 2 THEN '' ELSE substring(text, 1, 90) END AS text FROM documents), b AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare FROM r) SELECT source, sha256(regexp_replace(string_agg(head || text || repeat(chr(10), 3), '' ORDER BY number, doc_id), '\\s+$', '') || chr(10)) AS sha, CAST(sum(length(head) + length(bare) + CASE WHEN bare = '' THEN 0 ELSE 1 END) AS BIGINT) AS alone_chars FROM b GROUP BY source",
    "range_files": f"""WITH {CHUNKS_SQL}, c AS (SELECT source, number, doc_id * 1000000 + ord AS o, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, r.i, r.label FROM chunks JOIN (VALUES (1, 1, 5, '1-5'), (2, 90, 99, '90-99'), (3, 4, 4, '4')) r(i, low, high, label) ON number BETWEEN low AND high),
 p AS (SELECT *, row_number() OVER (PARTITION BY source, i, number ORDER BY o) AS a, row_number() OVER (PARTITION BY source, i ORDER BY number, o) AS b FROM c)
 SELECT source, 'range_' || lpad(CAST(i AS VARCHAR), 3, '0') || '/' || label || '.txt' AS filename, sha256(regexp_replace(string_agg(CASE WHEN a = 1 AND b > 1 THEN repeat(chr(10), 2) ELSE '' END || CASE WHEN a = 1 THEN '=== ' || source || ' ===' || repeat(chr(10), 2) ELSE '' END || text || repeat(chr(10), 2), '' ORDER BY number, o), '\\s+$', '') || chr(10)) AS sha FROM p GROUP BY source, i, label""",
    "range_file_manifest": f"WITH {CHUNKS_SQL}, f AS (SELECT source, count(*) FILTER (number <= 5) AS chunks, CAST(sum(length(text)) FILTER (number <= 5) AS BIGINT) AS characters, count(*) FILTER (number = 4) AS four FROM chunks GROUP BY source) SELECT source, 3 AS total, chunks, characters, CASE WHEN four > 0 THEN 3 END AS index, CASE WHEN four > 0 THEN '4.json' END AS filename FROM f WHERE chunks > 0",
    "detailed_json": f"WITH {CHUNKS_SQL}, c AS (SELECT doc_id, count(*) AS n, max(length(text)) AS m, sum(length(text)) // count(*) AS a, sha256(arg_min(text, ord)) AS f FROM chunks GROUP BY doc_id) SELECT d.doc_id, sha256(d.text) AS text_sha, CASE WHEN d.doc_id % 3 <> 0 THEN 1 ELSE 0 END AS chapter_count, coalesce(n, 0) AS chunk_count, coalesce(m, 0) AS chunk_max, CAST(coalesce(a, 0) AS BIGINT) AS chunk_avg, CASE WHEN d.doc_id % 4 = 0 THEN 1 ELSE 0 END AS errors, f AS first_sha FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id",
    "timeline_script": "WITH p AS (SELECT DISTINCT conv_id, turn FROM conversations), q AS (SELECT *, 'file ''it''\\''''s ' || turn || '.png''' || chr(10) AS f, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM p) SELECT conv_id, sha256('ffconcat version 1.0' || chr(10) || string_agg(f || 'duration ' || CASE WHEN last THEN '2.499000000' ELSE '2.500000000' END || chr(10), '' ORDER BY turn) || max(f) FILTER (last)) AS sha FROM q GROUP BY conv_id",
}
