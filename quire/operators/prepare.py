"""From groups of chapters to chunks that can be spoken: slice, prepare, cut, verify, reuse, override.

Every step is a table keyed by group and plan. A plan's identity is that of all it depends on: the
group's text, its revision and every setting. Saved plans of the same identity, complete and with
the right digests, are reused; an anti join on identities finds the groups whose plans are missing
or stale, and only these are prepared and cut again. Nothing of a group that hasn't changed is read
but its saved chunks.

A group that can't be planned (no speakable text, a text that can't be cut, chunks that don't
make up the prepared text) is a row of problems and has no chunk; it doesn't stop the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import chunk, clean, jobs
from quire.session import persist_table

#: Rows of identities that are broadcast, counted first.
BROADCAST_ROWS = 100_000
#: Columns of a plan's chunks.
CHUNK = ("group_id", "plan_id", "ord", "number", "chapter_title", "text", "text_sha256", "reason", "visible_lines")


@dataclass(frozen=True)
class PrepareOptions:
    """Every setting that can change a plan."""

    cleaning: clean.CleanOptions = clean.CleanOptions()
    sanitizing: clean.SanitizeOptions = clean.SanitizeOptions()
    limit: int = chunk.SOFT
    budget: chunk.PageBudget | None = None

    def identity(self) -> str:
        return jobs.settings_identity(cleaning=self.cleaning.for_speech(), sanitizing=self.sanitizing, limit=chunk.clamp(self.limit), longest=chunk.MOST, budget=self.budget)


@dataclass
class Prepared:
    """chunks: CHUNK, edited and error of every plan, overrides applied; fresh: the chunks to be saved; states: group_id, plan_id, state (reused, fresh or failed) and problem."""

    chunks: DataFrame
    fresh: DataFrame
    states: DataFrame


def identified(groups: DataFrame, options: PrepareOptions = PrepareOptions()) -> DataFrame:
    """Groups (group_id, text_sha256, revision) with plan_id."""
    return groups.withColumn("plan_id", jobs.plan_id(F.col("text_sha256"), F.col("revision"), options.identity()))


def _few(ids: DataFrame) -> DataFrame:
    """A written table, broadcast where it has few rows, so that the texts it is joined to stay where they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def group_chapters(groups: DataFrame, spans: DataFrame, key: str = "source") -> DataFrame:
    """group_id, plan_id, number, source_line, header, title, text, chars: the chapters of groups (key, start, end, slice) by their headings' spans, and what stands before the first as number 0 without a header.

    Headings are gathered by group (there are no more than a slice has lines) before the slices are read, once.
    """
    place = ["group_id", "plan_id", key, "start", "end"]
    own = spans.select(F.col(key).alias("_key"), F.struct(F.col("start").alias("from"), "number", F.col("heading").alias("header"), F.col("body_start").alias("low"), F.col("end").alias("high")).alias("_h"))
    inside = (F.col(key) == F.col("_key")) & (F.col("_h.from") >= F.col("start")) & (F.col("_h.from") < F.col("end"))
    found = persist_table(groups.select(*place).distinct().join(own, inside).groupBy(*place).agg(F.sort_array(F.collect_list("_h")).alias("_own")), "headings")
    both = groups.select(*place, "slice").join(_few(found), place, "left")
    first = F.coalesce(F.get("_own", F.lit(0))["from"], F.col("end"))
    lead = F.struct(F.lit(-1).cast("long").alias("from"), F.lit(0).cast("long").alias("number"), F.lit("").alias("header"), F.col("start").alias("low"), first.alias("high"))
    every = both.select("group_id", "plan_id", "start", "slice", F.explode(F.concat(F.array(lead), F.coalesce("_own", F.array()))).alias("_h"))
    text = F.substring(F.col("slice"), (F.col("_h.low") - F.col("start") + 1).cast("int"), (F.col("_h.high") - F.col("_h.low")).cast("int"))
    made = every.select("group_id", "plan_id", F.col("_h.number").alias("number"), F.col("_h.from").alias("source_line"), F.col("_h.header").alias("header"), F.lit("").alias("title"), text.alias("text"))
    return made.filter((F.col("source_line") >= 0) | F.col("text").rlike(r"[^ \r\n\t]")).withColumn("chars", F.length("text").cast("long"))


#: Every character that counts as white space.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _bare(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def cut_groups(chapters: DataFrame, options: PrepareOptions) -> DataFrame:
    """CHUNK, error and lossless of the chapters of groups: prepared, cut, and each chapter's chunks compared with its prepared text."""
    own = chapters.select(F.concat_ws("\u0000", "group_id", "plan_id").alias("_plan"), "number", "source_line", "header", "title", "text", "chars")
    ready = persist_table(clean.prepare_chapters(own, options.cleaning, options.sanitizing).select(*own.columns), "prepared")
    made = persist_table(chunk.plan_chapters(ready, "_plan", options.limit, with_header=True, budget=options.budget, abbreviations=tuple(options.sanitizing.abbreviations)), "cut")
    place = ["_plan", "number", "source_line"]
    digest = lambda text: F.sha2(_bare(text), 256)
    joined = made.groupBy(*place).agg(digest(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")).alias("_joined"))  # of one chapter
    want = ready.filter(F.concat("header", "text").rlike(r"[\p{L}\p{N}]")).select(*place, digest(F.when(F.col("header").rlike(r"[\p{L}\p{N}]"), F.concat("header", "text")).otherwise(F.col("text"))).alias("_want"))
    lost = persist_table(want.join(joined, place, "left").filter(~F.coalesce(F.col("_want") == F.col("_joined"), F.lit(False))).groupBy("_plan").agg(F.lit(False).alias("lossless")), "lost")
    out = made.join(_few(lost), "_plan", "left").withColumn("lossless", F.coalesce("lossless", F.lit(True)))
    ids = F.split("_plan", "\u0000")
    out = out.withColumn("group_id", ids[0]).withColumn("plan_id", ids[1]).withColumn("text_sha256", F.sha2("text", 256))
    return out.select(*CHUNK, "error", "lossless")


def prepare(groups: DataFrame, spans: DataFrame, saved: DataFrame | None = None, overrides: DataFrame | None = None, options: PrepareOptions = PrepareOptions(), key: str = "source") -> Prepared:
    """Plans of groups (key, group_id, revision, start, end, slice, text_sha256), from saved chunks (CHUNK) where they are as they would be made.

    spans: the headings of the texts (detect.heading_spans). overrides: plan_id, ord, text, of which
    only those of current plans count. group_id is text.
    """
    wanted = persist_table(identified(groups, options), "wanted")
    both = ["group_id", "plan_id"]
    ready = persist_table(jobs.reusable_plans(wanted, saved), "reusable") if saved is not None else wanted.select(*both).limit(0)
    stale = wanted.join(_few(ready) if saved is not None else ready, both, "left_anti")
    made = persist_table(cut_groups(group_chapters(stale, spans, key), options), "chunks")
    facts = made.groupBy(*both).agg(F.max("error").alias("error"), F.bool_and("lossless").alias("lossless"))
    problem = F.when(F.col("lossless").isNull(), "no_speakable_text").when(F.col("error").isNotNull(), F.col("error")).when(~F.col("lossless"), "chunks_differ_from_text")
    judged = stale.select(*both).join(facts, both, "left").select(*both, problem.alias("problem"))
    states = ready.select(*both, F.lit("reused").alias("state"), F.lit(None).cast("string").alias("problem"))
    states = persist_table(states.unionByName(judged.select(*both, F.when(F.col("problem").isNull(), "fresh").otherwise("failed").alias("state"), "problem")), "states")
    fresh = made.join(_few(states.filter("state = 'failed'")), both, "left_anti").select(*CHUNK)  # a group with chunks is fresh or failed
    every = fresh if saved is None else fresh.unionByName(saved.join(ready, both, "left_semi").select(*CHUNK))
    none = every.select("plan_id", "ord", "text").limit(0) if overrides is None else overrides
    budget = options.budget
    return Prepared(jobs.effective_chunks(every, none, chunk.MOST, budget.lines_of if budget else None, budget.lines if budget else 0), fresh, states)


def page_states(chunks: DataFrame, budget: chunk.PageBudget) -> DataFrame:
    """group_id, ord, state of saved chunks (visible_lines, text) on a page: current, moved (it takes another number of lines than when it was saved) or over_budget."""

    @F.pandas_udf("int")
    def used(texts):
        return texts.map(lambda t: budget.lines_of(t or ""))

    lines = used("text")
    return chunks.withColumn("_lines", lines).select("group_id", "ord", F.when(F.col("_lines") > budget.lines, "over_budget").when(F.col("_lines") != F.col("visible_lines"), "moved").otherwise("current").alias("state"))
