"""Operators on chapter and chunk rows: ranges, renumbering, statistics, merges, incremental work.

Rows carry their key and order. What runs along a key that may hold a large part of all rows goes
through the prefix scan of scan.py; windows are for keys of bounded size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quire.operators.parts import digests, ordered_parts
from quire.operators.scan import Ranges

# ---------------------------------------------------------------- ranges


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """Ranges such as "1-5, 8, 10-12"; parts that aren't ranges, reversed ones and numbers beyond 18 digits, leading zeros aside, are passed over."""
    import re

    out = []
    for part in (text or "").split(","):
        found = re.fullmatch(r"\s*0*([0-9]{1,18})\s*(?:-\s*0*([0-9]{1,18})\s*)?", part)
        if found and int(found[1]) <= int(found[2] or found[1]):
            out.append((int(found[1]), int(found[2] or found[1])))
    return out


def range_column(text: Column) -> Column:
    """The same of a column: an array of (low, high). Numbers beyond 18 digits, leading zeros aside, are passed over."""
    parts = F.filter(F.split(text, ","), lambda p: p.rlike(r"^\s*0*[0-9]{1,18}\s*(?:-\s*0*[0-9]{1,18}\s*)?$"))
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "([0-9]+)", 1).cast("long").alias("low"), F.coalesce(F.nullif(F.regexp_extract(p, r"-\s*([0-9]+)", 1), F.lit("")), F.regexp_extract(p, "([0-9]+)", 1)).cast("long").alias("high")))
    return F.filter(pairs, lambda p: p["low"] <= p["high"])


def range_error(text: Column) -> Column:
    """empty or no_range for texts without a valid range; null for others."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "empty").when(F.size(range_column(text)) == 0, "no_range")


def range_label(low: Column, high: Column) -> Column:
    """ "low-high", or the number of a range of one."""
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))


def range_count(low: Column, high: Column) -> Column:
    """Numbers in a range; none in a reversed one."""
    return F.greatest(high - low + 1, F.lit(0)).cast("long")


def merged_ranges(rows: DataFrame, ranges: str = "ranges", keys: list[str] | None = None) -> DataFrame:
    """keys, low, high: the union of arrays of ranges (low, high) as ranges that neither overlap nor touch.

    A sweep over their lower ends: a range begins a new one where it lies beyond all before it by
    more than one. Nothing depends on how many numbers a range holds.
    """
    keys = keys or []
    each = rows.select(*keys, F.explode(ranges).alias("r")).select(*keys, "r.low", "r.high").filter("low <= high").distinct()
    scan = Ranges(each, keys, ["low", "high"]).greatest("_top", F.col("high")).before("_before", F.col("_top"))
    told = scan.running("_nr", (F.col("_before").isNull() | (F.col("low") - 1 > F.col("_before"))).cast("long")).rows()
    return told.groupBy(*keys, "_nr").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_nr")


def expand_ranges(rows: DataFrame, ranges: str = "ranges", keys: list[str] | None = None, most: int = 100_000) -> DataFrame:
    """keys, number: the distinct numbers of arrays of ranges (low, high), of each range of their union the first so many; merged_ranges has all of them, as ranges."""
    keys = keys or []
    one = merged_ranges(rows, ranges, keys)
    return one.select(*keys, F.explode(F.sequence("low", F.least(F.col("high"), F.col("low") + (most - 1)))).alias("number"))


def in_ranges(rows: DataFrame, ranges: list[tuple[int, int]], column: str = "number") -> DataFrame:
    """Rows whose number lies in a range; all rows if there is none. A predicate, so it reaches the scan."""
    if not ranges:
        return rows
    test = F.lit(False)
    for low, high in ranges:
        test = test | F.col(column).between(low, high)
    return rows.filter(test)


def blocks(ends: DataFrame, size: int, key: str = "source") -> DataFrame:
    """key, low, high: blocks of size numbers over ends (key, first, last)."""
    many = 1_000_000  # blocks that are made at once
    outer = ends.filter("first <= last").select(key, "first", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first")) / (size * many)))).alias("_far"))
    begin = F.col("first") + F.col("_far") * (size * many)
    starts = F.explode(F.sequence(begin, F.least(F.col("last"), begin + (size * many - size)), F.lit(size).cast("long")))
    return outer.select(key, starts.alias("low"), "last").select(key, "low", F.least(F.col("low") + size - 1, "last").alias("high"))


# ---------------------------------------------------------------- numbering


def renumber(rows: DataFrame, order: list[str], key: str, column: str = "number") -> DataFrame:
    """Rows with renumbered (1, 2, ... by key in the given order) and changed."""
    out = Ranges(rows, [key], order).number("renumbered").rows()
    return out.withColumn("changed", (F.col(column) != F.col("renumbered")).cast("long"))


def with_parts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with the number of chunks of their chapter."""
    return chunks.withColumn("parts", F.count(F.lit(1)).over(W.partitionBy(*keys)))


def insert_headers(sources: DataFrame, key: str = "grp", *, continuous: bool = True) -> DataFrame:
    """Sources (key, ord, number or null) with assigned: headless ones get the numbers that follow the last headed source before them, or (continuous off) 1, 2, 3 ... whatever has a header.

    number is the largest header number of a source. A source with a text column that is blank
    gets no number and uses none up.
    """
    blank = F.length(F.trim("text")) == 0 if "text" in sources.columns else F.lit(False)
    wants = F.col("number").isNull() & ~blank
    scan = Ranges(sources, [key], ["ord"]).running("_wanted", wants.cast("long"))
    if not continuous:
        return scan.rows().withColumn("assigned", F.when(F.col("number").isNotNull(), F.col("number")).when(wants, F.col("_wanted"))).drop("_wanted")
    told = scan.last("_base", F.when(F.col("number").isNotNull(), F.struct("number", "_wanted"))).rows()
    since = F.coalesce(F.col("_base.number"), F.lit(0)) + F.col("_wanted") - F.coalesce(F.col("_base._wanted"), F.lit(0))
    return told.withColumn("assigned", F.when(F.col("number").isNotNull(), F.col("number")).when(wants, since)).drop("_wanted", "_base")


def put_headers(sources: DataFrame, prefix: str = "Chương {n}") -> DataFrame:
    """Sources (number, assigned, text) with header and text of those that lacked one, and injected."""
    injected = F.col("number").isNull() & F.col("assigned").isNotNull()
    header = F.replace(F.lit(prefix.replace("{number}", "{n}")), F.lit("{n}"), F.col("assigned").cast("string"))
    text = F.when(injected, F.concat(header, F.lit("\n"), F.regexp_replace("text", r"\A\s+", ""))).otherwise(F.col("text"))
    return sources.withColumn("injected", injected).withColumn("text", text)


def merge_texts(rows: DataFrame, order: str, key: str = "source") -> DataFrame:
    """key, part, text: texts that aren't blank, without line ends at both ends, joined by a blank line; in parts of bounded size whose texts make up the whole."""
    trimmed = F.regexp_replace("text", r"\A\n+|\n+\z", "")
    return ordered_parts(rows, [key], [order], F.when(F.length(F.trim(trimmed)) > 0, trimmed), between="\n\n")


def explicit_order(sources: DataFrame, wanted: DataFrame, key: str = "grp") -> DataFrame:
    """Sources (key, name, ord and perhaps path) by an explicit list (key, name, pos) of names or paths; those it doesn't name follow in their order.

    The first mention counts. Where several sources have one name, a mention of it means the last of them.
    """
    first = wanted.groupBy(key, "name").agg(F.min("pos").alias("pos"))
    named = sources.withColumn("last", F.row_number().over(W.partitionBy(key, "name").orderBy(F.col("ord").desc())) == 1)
    joined = named.join(first, [key, "name"], "left").withColumn("pos", F.when(F.col("last"), F.col("pos")))
    if "path" in sources.columns:
        by_path = first.select(key, F.col("name").alias("path"), F.col("pos").alias("path_pos"))
        joined = joined.join(by_path, [key, "path"], "left").withColumn("pos", F.least("pos", "path_pos")).drop("path_pos")
    scan = Ranges(joined.withColumn("_unnamed", F.col("pos").isNull()), [key], ["_unnamed", "pos", "ord"])
    return scan.number("position").rows().drop("last", "_unnamed")


def first_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by order (ties: any one, the same columns)."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*key).orderBy(order))).filter("_nth = 1").drop("_nth")


def last_rows(rows: DataFrame, n: int, sequence: str, key: str) -> DataFrame:
    """The n rows of each key with the largest sequence: what a log of n rows still holds."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.col(sequence).desc()))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")


def rows_after(rows: DataFrame, sequence: str, n: int) -> DataFrame:
    """The tail of a log after a sequence number; a predicate that reaches the scan."""
    return rows.filter(F.col(sequence) > n)


# ---------------------------------------------------------------- statistics


def chunk_statistics(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks, characters, whole mean, least, largest and hard splits by keys; without keys, of all."""
    size = F.length("text").cast("long")
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"), F.sum(size).alias("characters"), F.floor(F.sum(size) / F.count(F.lit(1))).alias("mean_chars"), F.min(size).alias("min_chars"), F.max(size).alias("max_chars"), F.sum(F.col("hard_split").cast("long")).alias("hard_splits"))


def least_unset(sizes: Column) -> Column:
    """Least of an array of sizes in order, 0 counting as not set yet: what stands before a later 0 is forgotten."""
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda m, x: F.when((m == 0) | (x < m), x).otherwise(m))


def chapter_statistics(chunks: DataFrame, titles: DataFrame, key: str = "source", order: str = "ord") -> DataFrame:
    """key, number, title, chunks, characters, min_chars, max_chars, hard_splits by chapter; the title is that of the chapter (first of its number), else of its first chunk.

    chunks: key, number, order, text, title, hard_split; titles: key, number, title, source_line.
    """
    size = F.length("text").cast("long")
    sizes = F.transform(F.array_sort(F.collect_list(F.struct(order, size.alias("n")))), lambda x: x["n"])  # of one chapter
    stats = chunks.groupBy(key, "number").agg(F.min_by("title", order).alias("own"), F.count(F.lit(1)).alias("chunks"), F.sum(size).alias("characters"), least_unset(sizes).alias("min_chars"), F.max(size).alias("max_chars"), F.sum(F.col("hard_split").cast("long")).alias("hard_splits"))
    named = first_of(titles, [key, "number"], "source_line").select(key, "number", "title")
    return stats.join(named, [key, "number"], "left").withColumn("title", F.coalesce("title", "own")).drop("own")


def total_characters(cleaned: Column, normalized: Column, of_chapters: Column, raw: Column) -> Column:
    """Characters of the latest form of a document that there is: cleaned, normalized, chapters (their sum), raw."""
    return F.coalesce(F.length(cleaned), F.length(normalized), of_chapters, F.length(raw), F.lit(0)).cast("long")


def severity_counts(diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    """Diagnostics (severity), by keys: total, errors, warnings, info."""
    count = lambda level: F.sum(F.when(F.col("severity") == level, 1).otherwise(0)).cast("long")
    return diagnostics.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("info"))


def without_stage(diagnostics: DataFrame, stage: str) -> DataFrame:
    """Diagnostics of other stages."""
    return diagnostics.filter(~F.col("stage").eqNullSafe(F.lit(stage)))


def upto_stage(rows: DataFrame, stage: str, stages: list[str]) -> DataFrame:
    """Rows of a stage and those before it: a change of a stage makes what follows it void. An unknown stage changes nothing."""
    if stage not in stages:
        return rows
    return rows.filter(F.col("stage").isin(stages[: stages.index(stage) + 1]))


def stage_counts(groups: DataFrame, key: str) -> DataFrame:
    """key, total, audio, video, upload, and whether each is done for all groups; groups: key, tts_status, audio_there, video_there, video_id."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    audio, video, upload = (F.col("tts_status") == "Completed") & F.col("audio_there"), F.col("video_there"), F.length(F.coalesce("video_id", F.lit(""))) > 0
    out = groups.groupBy(key).agg(F.count(F.lit(1)).alias("total"), count(audio).alias("audio"), count(video).alias("video"), count(upload).alias("upload"))
    return out.select("*", *((F.col(c) == F.col("total")).alias(f"{c}_done") for c in ("audio", "video", "upload")))


def group_status(stage: str) -> Column:
    """done, error or todo of a group (tts_status, audio_there, failures, video_there, last_error, video_id, upload_status) in a stage: tts, video or upload."""
    has = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    audio = F.coalesce((F.col("tts_status") == "Completed") & F.col("audio_there"), F.lit(False))
    if stage == "tts":
        issue = (F.coalesce("failures", F.lit(0)) > 0) | F.coalesce(F.col("tts_status").isin("Partial", "TTS Incomplete", "Cancelled", "Completed"), F.lit(False))
        return F.when(audio, "done").when(issue, "error").otherwise("todo")
    if stage == "video":
        return F.when(F.col("video_there"), "done").when(has("last_error") & audio, "error").otherwise("todo")
    return F.when(has("video_id"), "done").when(has("upload_status") & has("last_error"), "error").otherwise("todo")


def counter_merge(rows: DataFrame, counters: str, keys: list[str]) -> DataFrame:
    """Sums of maps of counters, by keys and counter."""
    return rows.select(*keys, F.explode(counters).alias("counter", "n")).groupBy(*keys, "counter").agg(F.sum("n").alias("n"))


def fingerprint(rows: DataFrame, order: str, key: str = "source") -> DataFrame:
    """key, fingerprint: SHA-256 over the digests of the texts in order, read as a stream; of the texts only digests are shuffled."""
    own = rows.select(key, order, F.sha2("text", 256).alias("text"))
    return digests(own, [key], [order, "text"], between="\n").select(key, F.col("sha256").alias("fingerprint"))


# ---------------------------------------------------------------- incremental work


def worklist(items: DataFrame, done: DataFrame, fields: list[str]) -> DataFrame:
    """Items that no finished record matches in all fields; equal nulls match."""
    same = None
    for f in fields:
        test = items[f].eqNullSafe(done[f])
        same = test if same is None else same & test
    return items.join(done, same, "left_anti")


def apply_overrides(plan: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Plan rows with the overriding text where one of the same plan exists; edited tells which."""
    new = overrides.select(*keys, F.col("text").alias("override"))
    joined = plan.join(new, keys, "left")
    return joined.withColumn("edited", F.col("override").isNotNull()).withColumn("text", F.coalesce("override", "text")).drop("override")


def validate_manifest(manifest: DataFrame, actual: DataFrame, keys: list[str], digest: str = "sha") -> DataFrame:
    """keys, state of each record or file: valid, stale (another digest), missing (no file) or unlisted (no record)."""
    both = manifest.select(*keys, F.col(digest).alias("listed")).join(actual.select(*keys, F.col(digest).alias("found")), keys, "full")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("found") == F.col("listed"), "valid").otherwise("stale")
    return both.select(*keys, state.alias("state"))


def aligned(left: DataFrame, right: DataFrame, order: str, fields: list[str], key: str) -> DataFrame:
    """key, n_left, n_right, same: whether two ordered lists of a key agree in all fields, position by position."""
    a, b = (Ranges(side.select(key, order, F.struct(*fields).alias(name)), [key], [order]).number("nth").rows().select(key, "nth", name) for side, name in ((left, "l"), (right, "r")))
    both = a.join(b, [key, "nth"], "full")
    equal = F.col("l").isNotNull() & F.col("r").isNotNull() & F.to_json("l").eqNullSafe(F.to_json("r"))
    return both.groupBy(key).agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.bool_and(equal).alias("same"))


def complete_join(chunks: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with their records, only of keys[0] values for which every chunk (text) has one record (text, text_sha256) with its text and the right digest, and no record is left over.

    Orders (keys[1]) must be 1, 2, 3 ... without a gap.
    """
    key, order = keys
    own = records.select(*keys, F.col("text").alias("recorded"), F.col("text_sha256").alias("sha"), *(c for c in records.columns if c not in (*keys, "text", "text_sha256")))
    both = chunks.join(own, keys, "full")
    fine = F.col("text").isNotNull() & F.col("recorded").isNotNull() & (F.col("text") == F.col("recorded")) & (F.sha2("recorded", 256) == F.col("sha"))
    whole = both.groupBy(key).agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("fine"), F.max(order).alias("top"), F.min(order).alias("low"), F.count(F.lit(1)).alias("n"), F.countDistinct(order).alias("different"))
    whole = whole.filter("fine and low = 1 and top = n and different = n").select(key)
    return both.join(whole, key, "left_semi").drop("recorded").withColumnRenamed("sha", "text_sha256")


def selection_errors(chosen: DataFrame, known: DataFrame, key: str, item: str) -> DataFrame:
    """key, n, repeated, unknown, error: empty can't be told here (such keys have no row), repeated items and items that aren't known are errors."""
    marked = chosen.join(known.select(key, item, F.lit(True).alias("known")).distinct(), [key, item], "left")
    out = marked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct(item)).alias("repeated"), F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).cast("long").alias("unknown"))
    return out.withColumn("error", F.when(F.col("repeated") > 0, "repeated").when(F.col("unknown") > 0, "unknown"))


def missing_files(paths: DataFrame, there: DataFrame, key: str, order: str) -> DataFrame:
    """key, path, ord: the distinct paths that no file has, in the order of their first mention."""
    wanted = paths.filter(F.length("path") > 0).groupBy(key, "path").agg(F.min(order).alias("ord"))
    return wanted.join(there.select("path").distinct(), "path", "left_anti")


def overlay(base: Column, over: Column, keep: list[str] | None = None) -> Column:
    """Map base with the entries of over on top, but for the keys in keep, which stay as base has them. Null maps count as empty."""
    empty = F.create_map().cast("map<string,string>")
    base, over = F.coalesce(base, empty), F.coalesce(over, empty)
    if keep:
        over = F.map_filter(over, lambda k, _: ~k.isin(*keep))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def upload_metadata(shared: Column, own: Column, title_of_group: Column, title: Column, label: Column) -> Column:
    """Metadata of a group: its own entries over the shared ones; the title is its own, else the one given for the group, else the shared one, else "title | label"."""
    merged = overlay(shared, own)
    name = F.coalesce(F.try_element_at(F.coalesce(own, F.create_map().cast("map<string,string>")), F.lit("title")), title_of_group, F.try_element_at(merged, F.lit("title")), F.concat_ws(" | ", title, label))
    return overlay(merged, F.create_map(F.lit("title"), name))


def page_label(number: Column, fallback: Column) -> Column:
    """ "Chương n" for a positive whole number, else the fallback."""
    n = number.cast("string").try_cast("long")
    return F.when(n > 0, F.concat(F.lit("Chương "), n.cast("string"))).otherwise(F.coalesce(fallback, F.lit("")))


def rounding_tolerance(codec: Column, rate: Column) -> Column:
    """Seconds by which the length of an audio file may differ from its samples: two frames, 2 ms at least."""
    samples = F.when(codec == "mp3", F.when(rate <= 24000, 576).otherwise(1152)).otherwise(1024)
    return F.greatest(F.lit(0.002), 2 * samples / rate)


def zoned_time(text: Column) -> Column:
    """Time of an ISO 8601 text with a time zone; null for others."""
    return F.when(text.rlike(r"(?i)^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(F.regexp_replace(text, r"([Tt ][0-9]{2}:[0-9]{2})(?=[Zz+-])", "$1:00")))


def tags_length(tags: Column) -> Column:
    """Characters that tags take where those with a space are quoted and all are joined by commas."""
    own = F.aggregate(tags, F.lit(0), lambda n, t: n + F.length(t) + F.when(F.contains(t, F.lit(" ")), 2).otherwise(0))
    return (own + F.greatest(F.size(tags) - 1, F.lit(0))).cast("long")


def story_key(title: Column) -> Column:
    """Titles that differ in case, width or white space only have one key (NFKC, case folded)."""
    return _folded(F.coalesce(title, F.lit("")))


@F.pandas_udf(T.StringType())
def _folded(titles: pd.Series) -> pd.Series:
    import unicodedata

    return titles.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def title_tags(titles: DataFrame, saved: DataFrame, title: str = "title") -> DataFrame:
    """titles with the tags saved for the first (least pos) saved title of the same story_key; null without one. saved: title, tags, pos."""
    own = saved.select(story_key(F.col("title")).alias("_key"), "tags", "pos").groupBy("_key").agg(F.min_by("tags", "pos").alias("tags"))
    return titles.withColumn("_key", story_key(F.col(title))).join(own, "_key", "left").drop("_key")


def latest_revision(rows: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """Rows of the latest revision of each key: what a later stage wrote before a change isn't seen."""
    last = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max(revision).alias("_last"))
    same = F.col(revision) == F.col("_last")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(last, same, "left_semi")


def without_tombstones(rows: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no tombstone names."""
    return rows.join(deleted, keys, "left_anti")


def timeline(chunks: DataFrame, key: str, order: str, seconds: Column) -> DataFrame:
    """Chunks with start and end on a time line, in microseconds rounded as ends are, so that rounding doesn't add up."""
    own = chunks.withColumn("_seconds", seconds.cast("decimal(38,9)"))
    told = Ranges(own, [key], [order]).running("_upto", F.col("_seconds")).rows()
    ends = told.withColumn("end_us", F.round(F.col("_upto") * 1_000_000).cast("long"))
    return ends.withColumn("start_us", F.round((F.col("_upto") - F.coalesce("_seconds", F.lit(0))) * 1_000_000).cast("long")).drop("_upto", "_seconds")
