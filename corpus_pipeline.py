"""A corpus pipeline: toxicity, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of docs, rows unchanged; the last returns each text's tokens.

Defined results of the four filters: null and empty texts are never toxic (score of a text
without terms), near copies or benchmark passages; as exact copies of each other all but the
one of the largest id go. Decisions are made by doc_id: rows that repeat an id with its text
stay or go together, and rows whose id is null always stay. Of ties in a group the largest
id (exact copies) or the least (near copies) stays. Empty tables give empty tables, further
columns of any name pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontam, exact_dedup, jaccard_join, toxicity
from quire.llm.queries import crc_part, tokenizer_path
from quire.llm.words import BROADCAST_ROWS


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows of the given doc_ids, which are written as a table first and broadcast only if few."""
    from quire.session import persist_table

    gone = persist_table(ids.select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5; no row is shuffled."""
    from quire.session import in_batches

    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_part(5) != 0)
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([model is None or model.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return in_batches(docs).mapInArrow(run, docs.schema)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, the one with the largest doc_id."""
    found = exact_dedup.exact_dedup(docs)
    return _without(docs, found.filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 Jaccard similarity join, the one with the least doc_id."""
    found = jaccard_join.jaccard_join(docs)
    return _without(docs, found.filter("doc_id <> class_id"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontam.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of each document."""
    out = bpe.encode_texts(docs, tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: The trained model of the first stage has no SQL form; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage keeps is written before the next reads it."""
    from quire.session import persist_table

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = persist_table(docs, name)
    return docs
