"""Groups, plans, sessions and their states as tables: what is current, what can be reused, what must be done again.

States are appended, never changed: the latest row of a key counts, so a writer that is
lost leaves the state before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.operators.scan import Ranges

def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by order."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).filter("_nth = 1").drop("_nth")


def changes(states: DataFrame, key: str, order: str, revision: str = "revision") -> DataFrame:
    """States as a reader sees them: the first of each key in full, then only those whose revision differs from the one before."""
    told = Ranges(states, [key], [order]).before("_before", F.col(revision)).rows()
    return told.filter(F.col("_before").isNull() | (F.col("_before") != F.col(revision))).drop("_before")


# ---------------------------------------------------------------- groups

GROUP_FIELDS = ("start", "end", "label", "range_label", "name", "group_id", "source_sha256", "text_sha256")


def check_manifest(manifest: DataFrame, expected: DataFrame, deleted: DataFrame | None = None, key: str = "source") -> DataFrame:
    """key, ord, group_id, state of each group of a manifest or of the recomputed ones (expected, both with GROUP_FIELDS).

    current; moved (label, span or name differ); stale (the text differs); foreign (another
    identity); missing (not in the manifest); surplus (not recomputed); deleted, for current ones
    that a tombstone names. A key is restorable if all its groups are current or deleted.
    """
    a = manifest.select(key, "ord", *(F.col(f).alias(f"m_{f}") for f in GROUP_FIELDS))
    b = expected.select(key, "ord", *(F.col(f).alias(f"e_{f}") for f in GROUP_FIELDS))
    both = a.join(b, [key, "ord"], "full")
    differs = lambda *fields: ~_all(F.col(f"m_{f}").eqNullSafe(F.col(f"e_{f}")) for f in fields)
    state = (
        F.when(F.col("m_group_id").isNull(), "missing")
        .when(F.col("e_group_id").isNull(), "surplus")
        .when(differs("start", "end", "label", "range_label", "name"), "moved")
        .when(differs("source_sha256", "text_sha256"), "stale")
        .when(differs("group_id"), "foreign")
        .otherwise("current")
    )
    out = both.select(key, "ord", F.coalesce("m_group_id", "e_group_id").alias("group_id"), state.alias("state"))
    if deleted is None:
        return out
    gone = deleted.select(key, "group_id", F.lit(True).alias("_gone")).distinct()
    return out.join(gone, [key, "group_id"], "left").withColumn("state", F.when((F.col("state") == "current") & F.col("_gone"), "deleted").otherwise(F.col("state"))).select(key, "ord", "group_id", "state")


def _all(tests) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def restorable(checked: DataFrame, key: str = "source") -> DataFrame:
    """key, restorable, active, deleted of check_manifest's rows."""
    count = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0)).cast("long")
    return checked.groupBy(key).agg(F.bool_and(F.col("state").isin("current", "deleted")).alias("restorable"), count("current").alias("active"), count("deleted").alias("deleted"))


def delete_groups(manifest: DataFrame, seen: DataFrame, chosen: DataFrame, key: str = "source") -> DataFrame:
    """Tombstones (key, group_id) of the chosen groups, only of keys whose manifest still is what the user has seen (key, ord, group_id)."""
    sides = (rows.select(key, "ord", "group_id", F.lit(n).alias("n")) for rows, n in ((manifest, 1), (seen, -1)))
    rows = next(sides).unionByName(next(sides)).groupBy(key, "ord", "group_id").agg(F.sum("n").alias("n"))
    same = rows.groupBy(key).agg(F.bool_and(F.col("n") == 0).alias("same")).filter("same").select(key)
    return chosen.select(key, "group_id").join(manifest.select(key, "group_id"), [key, "group_id"], "left_semi").join(same, key, "left_semi").distinct()


def file_states(groups: DataFrame, files: DataFrame) -> DataFrame:
    """group_id, valid, reason: whether the two files (filename, content) of each group (group_id, name, slice, json_sha256) are there, unchanged, and say what the group says."""
    text = files.select(F.col("filename").alias("_t"), F.col("content").alias("txt"))
    json = files.select(F.col("filename").alias("_j"), F.col("content").alias("json"))
    both = groups.join(text, F.concat("name", F.lit("/final.txt")) == F.col("_t"), "left").join(json, F.concat("name", F.lit("/final.json")) == F.col("_j"), "left")
    reason = (
        F.when(F.col("txt").isNull() | F.col("json").isNull(), "missing")
        .when((F.col("txt") != F.col("slice")) | (F.sha2("json", 256) != F.col("json_sha256")), "modified")
        .when(~(F.get_json_object("json", "$.text").eqNullSafe(F.col("slice")) & F.get_json_object("json", "$.group_id").eqNullSafe(F.col("group_id"))), "inconsistent")
    )
    return both.select("group_id", reason.isNull().alias("valid"), reason.alias("reason"))


def job_states(groups: DataFrame, states: DataFrame, order: str = "saved_at") -> DataFrame:
    """Groups with the latest state saved for the same group_id and text_sha256; null for others. Any other text's state doesn't count."""
    last = latest(states, ["group_id", "text_sha256"], order)
    return groups.join(last, ["group_id", "text_sha256"], "left")


def file_fingerprints(files: DataFrame) -> DataFrame:
    """path, size, modified of rows of a file source: enough to tell that a file wasn't touched."""
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


def touched(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, change of files whose fingerprint differs: gone, new or changed."""
    a, b = (x.select("path", F.struct("size", "modified").alias(n)) for x, n in ((before, "a"), (now, "b")))
    change = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change is not null")


# ---------------------------------------------------------------- plans


def plan_id(text_sha256: Column, revision: Column, config: str) -> Column:
    """Identity of a chunk plan: of the text, its revision and every setting that can move a boundary."""
    return F.sha2(F.concat_ws("\u0000", text_sha256, revision.cast("string"), F.lit(config)), 256)


def settings_identity(**settings: object) -> str:
    """Settings as text with sorted keys, the same for equal settings; dataclasses count by their fields."""
    import dataclasses
    import json

    plain = lambda v: dataclasses.asdict(v) if dataclasses.is_dataclass(v) else str(v)
    return json.dumps(settings, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=plain)


def reusable_plans(wanted: DataFrame, saved: DataFrame) -> DataFrame:
    """group_id, plan_id of wanted (group_id, plan_id) whose saved chunks (group_id, plan_id, ord, text, text_sha256) are numbered 1, 2, 3 ... and have the right digests."""
    told = saved.select("group_id", "plan_id", "ord", (F.sha2("text", 256) == F.col("text_sha256")).alias("fine"))  # texts aren't shuffled
    own = told.join(wanted.select("group_id", "plan_id"), ["group_id", "plan_id"], "left_semi")
    facts = own.groupBy("group_id", "plan_id").agg(F.bool_and("fine").alias("fine"), F.count(F.lit(1)).alias("n"), F.countDistinct("ord").alias("different"), F.min("ord").alias("low"), F.max("ord").alias("top"))
    return facts.filter("fine and low = 1 and top = n and different = n").select("group_id", "plan_id")


def effective_chunks(plan: DataFrame, overrides: DataFrame, longest: int, lines_of: Callable[[str], int] | None = None, lines: int = 0) -> DataFrame:
    """Chunks of plans (plan_id, ord, text) with their overriding texts, edited and error.

    error: invalid for a text without letters and digits or longer than longest, over_budget for an
    edited text that takes more than lines (by lines_of). Overrides of other plans don't count (see stale_overrides).
    """
    new = overrides.select("plan_id", "ord", F.col("text").alias("_new"))
    out = plan.join(new, ["plan_id", "ord"], "left").withColumn("edited", F.col("_new").isNotNull() & (F.col("_new") != F.col("text"))).withColumn("text", F.coalesce("_new", "text")).drop("_new")
    error = F.when(~F.col("text").rlike(r"[\p{L}\p{N}]") | (F.length("text") > longest), "invalid")
    if lines_of is not None:

        @F.pandas_udf("int")
        def used(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: lines_of(t) if t else 0)

        error = F.coalesce(error, F.when(used(F.when(F.col("edited"), F.col("text"))) > lines, "over_budget"))
    return out.withColumn("error", error)


def stale_overrides(plan: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides of plans that aren't current: kept, but not applied."""
    return overrides.join(plan.select("plan_id").distinct(), "plan_id", "left_anti")


def accept_edits(edits: DataFrame, failed: DataFrame, longest: int) -> DataFrame:
    """Edits (plan_id, ord, text) of chunks that failed (plan_id, ord) and whose text may be spoken; only these may be saved as overrides."""
    fine = edits.filter(F.col("text").rlike(r"[\p{L}\p{N}]") & (F.length("text") <= longest))
    return fine.join(failed.select("plan_id", "ord"), ["plan_id", "ord"], "left_semi")


# ---------------------------------------------------------------- sessions


def save_session(session_id: Column, title: Column, document: Column, settings: Column, ui: Column, at: Column) -> Column:
    """A session as JSON; document, settings and ui are structs or maps."""
    named = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Phiên chưa đặt tên"))
    return F.to_json(F.struct(F.lit(1).alias("schema_version"), session_id.alias("id"), named.alias("title"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("updated_at"), document.alias("document"), settings.alias("settings"), ui.alias("ui")))


def load_sessions(rows: DataFrame) -> DataFrame:
    """id, title, updated_at, tab, document, settings, ui, error of rows (id, json): error names what is wrong with a session (no JSON, another schema or id, settings or ui that are no objects)."""
    get = lambda path: F.get_json_object("json", path)
    kind = lambda path: F.left(F.trim(get(path)), F.lit(1))
    fine_id = F.col("id").rlike("^[a-f0-9]{32}$")
    error = (
        F.when(F.try_parse_json("json").isNull(), "no_json")
        .when(~fine_id | ~F.coalesce(get("$.schema_version") == "1", F.lit(False)) | ~F.coalesce(get("$.id") == F.col("id"), F.lit(False)), "unsupported")
        .when(~F.coalesce(kind("$.settings") == "{", F.lit(False)) | ~F.coalesce(kind("$.ui") == "{", F.lit(False)) | get("$.document").isNull(), "invalid")
    )
    tab = F.coalesce(get("$.ui.tab").try_cast("int"), F.when(get("$.ui.tab").isNull(), 0))
    return rows.select("id", get("$.title").alias("title"), F.try_to_timestamp(get("$.updated_at")).alias("updated_at"), tab.alias("tab"), get("$.document").alias("document"), get("$.settings").alias("settings"), get("$.ui").alias("ui"), error.alias("error"))


def list_sessions(rows: DataFrame) -> DataFrame:
    """id, title, updated_at, step (1 to 5) of the sessions without an error; to be read newest first."""
    return load_sessions(rows).filter("error is null").select("id", "title", "updated_at", F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce("tab", F.lit(0)) + 1)).alias("step"))


def newer_states(sessions: DataFrame, states: DataFrame) -> DataFrame:
    """Sessions' groups (group_id, text_sha256, updated_at, state) with the job's own state (saved_at, state) where it was saved after the session."""
    last = latest(states, ["group_id", "text_sha256"], "saved_at").select("group_id", "text_sha256", "saved_at", F.col("state").alias("_state"))
    both = sessions.join(last, ["group_id", "text_sha256"], "left")
    return both.withColumn("state", F.when(F.col("saved_at") > F.col("updated_at"), F.col("_state")).otherwise(F.col("state"))).drop("_state", "saved_at")


# ---------------------------------------------------------------- outside services


def map_with_retry(rows: DataFrame, key: str, value: str, call: Callable[[str], str], *, attempts: int = 5, at_once: int = 8, wait: Callable[[int], float] = lambda n: 0.0) -> DataFrame:
    """key, result, error, tries: call of each value, up to at_once at the same time in a task, each up to attempts times.

    A value whose every attempt fails has an error and no result; the others go on. wait: seconds before attempt n + 1.
    """
    kind = rows.schema[key].dataType.simpleString()

    def one(value: str) -> tuple[str | None, str | None, int]:
        import time

        for n in range(1, attempts + 1):
            try:
                return call(value), None, n
            except Exception as error:  # noqa: BLE001  whatever a service raises is the row's error
                last = f"{type(error).__name__}: {error}"
                if n < attempts:
                    time.sleep(wait(n))
        return None, last, attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                done = list(pool.map(one, batch[value]))
                yield pd.DataFrame({key: batch[key], "result": [d[0] for d in done], "error": [d[1] for d in done], "tries": [d[2] for d in done]})

    return rows.select(key, value).mapInPandas(run, f"{key} {kind}, result string, error string, tries int")
