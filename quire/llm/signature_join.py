"""Near copies by an inverted join over the coordinates of MinHash signatures.

Each text is the set of its runs of four words; texts with the same set are one class, which
its least id stands for. A class is posted under each of the SIZE coordinates of its signature
with the value that it has there. Two sets at the threshold share at least LEAST coordinates
(but for about 4 pairs in a million, see `missed`), and that number of collisions is what makes
a pair of classes a candidate.

Prefix: coordinate values that only one class has can't collide; a class with fewer than LEAST
others is out. The others are ordered by the number of classes that have them, rarest first,
the same for all classes. Two classes that share LEAST of them share one among the first
m - LEAST + 1 of either (m: how many the class has), so only these are posted. Values that
very many texts share, as those of a common passage, stand at the end and are seldom posted.

Skip: lists with the same members are merged once. In a short list the collisions of all pairs
are counted. In a long one they are counted with one member first, the pivot; members that
collide often enough with it are in one candidate group already, so pairs of two such are
skipped, and only those with a member that doesn't are counted, in pairs of bounded blocks.

Candidates are joined to groups, and in each group every pair is confirmed on the full sets of
the whole texts, in blocks of bounded size. Confirmed links give the components.

Skew: copies are one class; a value that many classes share is broadcast with its count, and
its postings stay where they are; long lists and large groups are dealt in pairs of blocks. A
group of n different texts takes n^2 comparisons of bounded blocks, whether its pairs are
similar or only near the threshold.

Defined results: A-Z are lower-cased and words end at blanks, tabs, line and page ends. A text
of one to three words is one run of all of them. Null texts and texts without a word have no
run, are linked with nothing and are kept; so are rows without an id, whose component is null.
Rows that repeat an id are one text. Ids may be of any type that has an order. Of a component
the least id is kept. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.jaccard_join import LEAF, SIZE, _counted, block_links, embed, exact_links, leaf_links, pivot_links
from quire.llm.words import WordHashes, hot_from, join_hot, shingle_set, with_texts
from quire.session import in_batches, persist_table

#: Collisions that make a candidate.
LEAST = 36


def missed(similarity: float, least: int = LEAST) -> float:
    """Probability that two sets of a similarity collide in fewer than least of the SIZE coordinates."""
    return sum(math.comb(SIZE, c) * similarity**c * (1 - similarity) ** (SIZE - c) for c in range(least))


def word_hashes(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words of a text in UTF-8, in order."""
    found = text.lower().split() if text else []
    return np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))


def signatures(docs: DataFrame, *, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, set_key (of the set of runs), n (its size), values (the signature) of the texts that have a word."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        from hashlib import blake2b

        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            keep, key, n, values = [], [], [], []
            for at, t in enumerate(batch.column(1).cast(pa.binary())):
                own = shingle_set(word_hashes(t.as_py(), hashes), words)
                if len(own):
                    keep.append(at)
                    key.append(blake2b(own.tobytes(), digest_size=16).digest())
                    n.append(len(own))
                    values.append(embed(own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "set_key", "n", "values"])

    return in_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, set_key binary, n long, values binary")


def postings(reps: DataFrame) -> DataFrame:
    """path (a coordinate with a value, as one number), rep: all postings of rows (rep, values)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, SIZE).astype(np.int64)
            path = values | (np.arange(SIZE, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(path.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(values)), SIZE)))], ["path", "rep"])

    return reps.select("rep", "values").mapInArrow(run, f"path long, rep {reps.schema['rep'].dataType.simpleString()}")


def prefixes(reps: DataFrame, least: int) -> DataFrame:
    """path, rep: of each set the rarest m - least + 1 of the m coordinate values that it shares with others."""
    every = postings(reps)
    counts = persist_table(every.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    shared = join_hot(every, counts, ["path"], "n", hot_from(reps.count() * SIZE))
    own = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "path"))).alias("own")).filter(F.size("own") >= least)
    return own.select("rep", F.explode(F.expr(f"slice(own, 1, size(own) - {least} + 1)")).alias("p")).select("p.path", "rep")


def merged_lists(rows: DataFrame) -> DataFrame:
    """path, size: one list (path, rep) of those with the same members, without lists of one member."""
    member = F.xxhash64("rep").cast("decimal(20,0)")
    lists = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum(member).alias("own"), F.sum(F.xxhash64("rep", F.lit(37)).cast("decimal(20,0)")).alias("other")).filter("size > 1")
    return lists.groupBy("size", "own", "other").agg(F.min("path").alias("path")).select("path", "size")


def candidates(reps: DataFrame, least: int = LEAST) -> DataFrame:
    """Links (a, b) that join all sets (rep, values) which collide in at least so many coordinates."""
    rows = persist_table(prefixes(reps, least), "prefixes")
    lists = persist_table(merged_lists(rows), "lists")
    posted = persist_table(join_hot(rows, lists, ["path"], "size", hot_from(rows.count())), "posted")
    full = persist_table(posted.join(reps.select("rep", "values"), "rep"), "lists")
    share = least / SIZE
    out = persist_table(leaf_links(full.filter(F.col("size") <= LEAF).select("path", "rep", "values"), share), "links")
    long = full.filter(F.col("size") > LEAF).select("path", F.lit(0).cast("long").alias("used"), "rep", "values")
    if long.isEmpty():
        return out
    split = persist_table(pivot_links(long, 0, share, share, share), "split")
    near = split.filter("near > 1 and pivot <> rep").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    far = block_links(_counted(split.withColumn("far", F.col("near") < 2)), share)
    return out.unionByName(persist_table(near, "links")).unionByName(persist_table(far, "links"))


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """rep, copies, grp, shingles (sorted 64-bit hashes of the runs) of rows (rep, text, copies, grp)."""
    kind = texts.schema["rep"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(word_hashes(t.as_py(), hashes), words).tobytes() for t in batch.column(3).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sets, pa.binary())], ["rep", "copies", "grp", "shingles"])

    return in_batches(texts.select("rep", "copies", "grp", "text")).mapInArrow(run, f"rep {kind}, copies long, grp {kind}, shingles binary")


def near_copies(docs: DataFrame, *, threshold: float = 0.8, words: int = 4, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    least is set for a threshold of 0.8; take a smaller one for a lower threshold (`missed`).
    """
    rows = persist_table(signatures(docs.filter(F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col, words=words), "signatures")
    reps = persist_table(rows.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("values").alias("values")), "reps")
    groups = components(candidates(reps, least))
    members = persist_table(groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")).join(reps.select("rep", "copies"), "rep"), "members")
    texts = with_texts(docs, members.withColumnRenamed("rep", "doc_id"), id_col=id_col, text_col=text_col).withColumnRenamed("doc_id", "rep")
    found = exact_links(persist_table(full_sets(texts, words), "sets"), threshold)
    classes = components(found.filter("rep <> b").select(F.col("rep").alias("a"), "b"))
    known = reps.select("set_key", "rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    sizes = rows.select("doc_id", "set_key", F.col("n").alias("n_shingles"))
    every = docs.select(F.col(id_col).alias("doc_id"))
    alone = every.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = sizes.join(known, "set_key").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
