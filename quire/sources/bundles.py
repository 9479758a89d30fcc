"""Bundles of a whole document: its prepared text and its chunks as a pair of files that vouch for each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import clean, prepare
from quire.operators.parts import digests, ordered_parts
from quire.operators.scan import Ranges
from quire.session import persist_table
from quire.sources.sinks import render_parts


@dataclass
class Bundles:
    """files: key, filename, part, text of <key>/chunks.txt and <key>/chunks.json; facts: a row a document with the digests of text, chunks and files, and chunk_count."""

    files: DataFrame
    facts: DataFrame


def whole_documents(texts: DataFrame, key: str = "source") -> DataFrame:
    """Documents (key, text, revision) as one group each, for prepare.prepare and bundles."""
    return texts.select(F.col(key).cast("string").alias(key), F.col(key).cast("string").alias("group_id"), "revision", F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), F.col("text").alias("slice"), F.sha2("text", 256).alias("text_sha256"))


def bundles(texts: DataFrame, spans: DataFrame, options: prepare.PrepareOptions = prepare.PrepareOptions(), key: str = "source") -> Bundles:
    """Bundles of documents (key, text, revision) by their headings' spans; documents that can't be cut have none (prepare.prepare tells why)."""
    groups = persist_table(prepare.identified(whole_documents(texts, key), options), "documents")
    made = prepare.prepare(groups.drop("plan_id"), spans, options=options, key=key)
    chunks = persist_table(made.fresh.withColumnRenamed("group_id", "_id"), "chunks")
    chapters = prepare.group_chapters(groups, spans, key).join(chunks.select(F.col("_id").alias("group_id")).distinct(), "group_id", "left_semi")
    ready = clean.prepare_chapters(chapters, options.cleaning, options.sanitizing).select(F.col("group_id").alias("_id"), "number", "source_line", "header", "text")
    text = persist_table(render_parts(ready, "_id", "\n\n"), "text")
    told = digests(text, ["_id"]).select("_id", F.col("sha256").alias("text_sha256"))
    told = told.join(digests(chunks.select("_id", "ord", F.col("text_sha256").alias("text")), ["_id"], ["ord"], between="\n").select("_id", F.col("sha256").alias("chunks_sha256")), "_id")
    told = told.join(chunks.groupBy("_id").agg(F.count(F.lit(1)).alias("chunk_count")), "_id").join(groups.select(F.col("group_id").alias("_id"), "revision"), "_id")
    told = persist_table(told, "facts")
    head = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("_id").alias("title"), F.col("revision").alias("source_revision"), F.col("text_sha256").alias("cleaned_text_sha256"), "chunks_sha256", "chunk_count"))
    numbered = Ranges(chunks.select("_id", "ord", "number", "chapter_title", "text", F.col("text_sha256").alias("sha")), ["_id"], ["ord"]).number("_n").rows().join(told, "_id")
    one = F.to_json(F.struct(F.col("ord").alias("order"), F.col("number").alias("chapter"), F.col("chapter_title"), F.col("text"), F.col("sha").alias("text_sha256")))
    first = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"chunks":['))
    piece = F.concat(F.when(F.col("_n") == 1, first).otherwise(","), one, F.when(F.col("_n") == F.col("chunk_count"), "]}").otherwise(""))
    json = persist_table(ordered_parts(numbered, ["_id"], ["_n"], piece), "json")
    name = lambda suffix: F.concat("_id", F.lit(f"/chunks.{suffix}")).alias("filename")
    files = text.select(F.col("_id").alias(key), name("txt"), "part", "text").unionByName(json.select(F.col("_id").alias(key), name("json"), "part", "text"))
    facts = told.join(digests(json, ["_id"]).select("_id", F.col("sha256").alias("json_sha256")), "_id").withColumn("txt_sha256", F.col("text_sha256"))
    return Bundles(files, facts.withColumnRenamed("_id", key))


def check_bundles(facts: DataFrame, now: DataFrame, written: DataFrame, key: str = "source") -> DataFrame:
    """key, state of bundles (facts): current; stale (the document has another revision, text or chunks now); missing or modified (a file isn't there, or has another digest than was written).

    now: key, revision, text_sha256, chunks_sha256; written: filename, sha256 of the files that are there.
    """
    a = now.select(key, *(F.col(c).alias(f"_{c}") for c in ("revision", "text_sha256", "chunks_sha256")))
    out = facts.join(a, key, "left")
    for suffix in ("txt", "json"):
        own = written.select(F.col("filename").alias(f"_{suffix}"), F.col("sha256").alias(f"_{suffix}_now"))
        out = out.join(own, F.concat(F.col(key), F.lit(f"/chunks.{suffix}")) == F.col(f"_{suffix}"), "left")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}"))
    state = (
        F.when(~(same("revision") & same("text_sha256") & same("chunks_sha256")), "stale")
        .when(F.col("_txt_now").isNull() | F.col("_json_now").isNull(), "missing")
        .when((F.col("_txt_now") != F.col("txt_sha256")) | (F.col("_json_now") != F.col("json_sha256")), "modified")
        .otherwise("current")
    )
    return out.select(key, state.alias("state"))
