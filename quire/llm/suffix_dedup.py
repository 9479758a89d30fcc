"""Repeated passages by sparse suffix arrays.

A passage counts as repeated when LENGTH words of it or more occur in another document.
Only suffixes that begin at content-selected positions are kept: of every
LENGTH - SEED + 1 neighbouring runs of SEED words, the one of least hash (the minimiser).
Both copies of a repeated passage select the same positions, and every run of LENGTH
words has one of them, with its SEED words, inside.

1. The kept suffixes are sorted over the cluster by their first SEED words, by what
   follows (the right context) and by what stands before (the left context); ranges of
   that order are streamed, and a suffix whose neighbours have other first words is
   dropped. Equal suffixes may lie in several ranges; those at a range's edge stay.
2. Suffixes of several documents with the same contexts (a class) lie in a repeated
   passage with all of their surroundings: nothing to extend.
3. Where a seed has several classes, each class is extended to the left and right: the
   windows of LENGTH words that contain the seed are looked up among those of the seed's
   other classes. Windows that two documents share are repeated.

Every LENGTH-word window that occurs in two documents is found, and none else but for
collisions of 64-bit hashes; the result is the union of them. A passage in a third of all
texts costs a few rows a class, which are aggregated map-side; frequent classes are
broadcast to their suffixes, which stay where they are.

Defined results: null texts and texts shorter than LENGTH words have no row, nor have texts
without a repeated passage, or whose passages are repeated in themselves only. Rows of
the same id are one document. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import WordHashes, hot_from, join_hot, mixed, windows, with_texts
from quire.session import in_batches, persist_table

LENGTH, SEED = 50, 20


def minimisers(seeds: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least of each width neighbouring hashes, the leftmost of equals."""
    n = len(seeds) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    order = mixed(seeds ^ np.uint64(0x5BD1E9955BD1E995))
    return np.unique(np.arange(n) + np.lib.stride_tricks.sliding_window_view(order, width).argmin(axis=1))


def _context(words: np.ndarray, at: np.ndarray, slack: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the slack words left and right of each seed; at a text's edge, of those there are."""
    n = len(words)

    def edge(begin: int, end: int) -> np.uint64:
        return windows(words[begin:end], end - begin)[0] if end > begin else np.uint64(0)

    full = windows(words, slack)
    left, right = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    inside = at >= slack
    left[inside] = full[at[inside] - slack]
    for k in np.flatnonzero(~inside):
        left[k] = edge(0, int(at[k]))
    inside = at + seed + slack <= n
    right[inside] = full[at[inside] + seed]
    for k in np.flatnonzero(~inside):
        right[k] = edge(int(at[k]) + seed, n)
    return left, right


def suffixes(docs: DataFrame, *, length: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, pos (in words), room (words of the right context), seed, right_ctx, left_ctx of the suffixes kept of each whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    slack = length - seed

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            ids, parts = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = hashes.of(t.as_py())
                if len(words) < length:
                    continue
                seeds = windows(words, seed)
                at = minimisers(seeds, slack + 1)
                parts.append((at, np.minimum(slack, len(words) - seed - at), seeds[at], *reversed(_context(words, at, slack, seed))))
                ids += [i] * len(at)
            if parts:
                pos, room, own, right, left = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(pos.astype(np.int32)), pa.array(room.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (own, right, left))], ["doc_id", "pos", "room", "seed", "right_ctx", "left_ctx"])

    return in_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pos int, room int, seed long, right_ctx long, left_ctx long")


def neighbours(kept: DataFrame) -> DataFrame:
    """Suffixes that share the seed with a neighbour in the sorted order, or stand at the edge of a sorted range.

    Memory holds a batch and a row, whatever the number of rows of a seed.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, edge = None, True  # edge: whether the first row stays, whatever follows
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            seed = table.column("seed").to_numpy()
            hit = seed[1:] == seed[:-1]
            keep = np.concatenate(([edge], hit)) | np.concatenate((hit, [False]))
            yield from table.slice(0, len(seed) - 1).filter(pa.array(keep[:-1])).combine_chunks().to_batches()
            edge = bool(keep[-1])
            held = table.slice(len(seed) - 1)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    order = ["seed", "right_ctx", "left_ctx", "doc_id", "pos"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    ranges = max(8, int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return kept.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


KEY = ["seed", "right_ctx", "left_ctx"]


def _extend(members: DataFrame, docs: DataFrame, *, length: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """KEY, offs: repeated windows around seeds of several classes, a bit for each number of words before the seed.

    members: KEY, one suffix (doc_id, pos) of each class, the least and largest id of its rows.
    """
    slack = length - seed
    ids = members.schema["lo"].dataType.simpleString()
    wanted = members.groupBy("doc_id").agg(F.collect_list(F.struct("pos", *KEY, "lo", "hi")).alias("at"))  # suffixes of one text

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for t, at in zip(batch.column("text"), batch.column("at").to_pylist(), strict=True):
                every = windows(hashes.of(t.as_py()), length).view(np.int64)
                for s in at:
                    first = max(0, s["pos"] - slack)
                    found = every[first : s["pos"] + 1].tolist()
                    out[0] += found
                    out[1] += range(s["pos"] - first, s["pos"] - first - len(found), -1)
                    for column, name in zip(out[2:], (*KEY, "lo", "hi"), strict=True):
                        column += [s[name]] * len(found)
            kind = batch.schema.field("at").type.value_type.field("lo").type
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), kind, kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["window", "off", *KEY, "lo", "hi"])

    texts = with_texts(docs, wanted, id_col=id_col, text_col=text_col, wide=True)
    found = persist_table(texts.select("text", "at").mapInArrow(run, f"window long, off int, seed long, right_ctx long, left_ctx long, lo {ids}, hi {ids}"), "windows")
    shared = found.groupBy("window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("window")
    return found.select("window", "off", *KEY).join(shared, "window").groupBy(*KEY).agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("offs"))


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (in words, end exclusive), n_words: the repeated passages of each text, a row each."""
    slack = length - seed
    if not 0 <= slack < 63:
        raise ValueError("a passage may be up to 62 words longer than its seed")
    kept = persist_table(suffixes(docs, length=length, seed=seed, id_col=id_col, text_col=text_col), "suffixes")
    near = persist_table(neighbours(kept), "near")
    one = F.struct("doc_id", "pos")
    classes = persist_table(near.groupBy(*KEY).agg(F.min_by(one, one).alias("one"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")), "classes")
    several = classes.groupBy("seed").agg(F.count(F.lit(1)).alias("classes"), F.min("lo").alias("least"), F.max("hi").alias("most")).filter("classes > 1 and least <> most").select("seed")
    members = classes.join(several, "seed").select(*KEY, "one.doc_id", "one.pos", "lo", "hi")
    offsets = _extend(members, docs, length=length, seed=seed, id_col=id_col, text_col=text_col)
    whole = F.lit((1 << slack + 1) - 1).cast("long")
    reach = classes.select(*KEY, "n", (F.col("lo") != F.col("hi")).alias("same")).join(offsets, KEY, "left").select(*KEY, "n", F.when(F.col("same"), whole).otherwise(F.col("offs")).alias("offs")).filter("offs is not null")
    rows = join_hot(near, persist_table(reach, "reach"), KEY, "n", hot_from(near.count())).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "room", "offs")).alias("at"))  # suffixes of one text

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, begins, ends = [], [], []
            for i, at in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), strict=True):
                end = -1
                for start in sorted({s["pos"] - o for s in at for o in range(max(0, slack - s["room"]), min(slack, s["pos"]) + 1) if s["offs"] >> o & 1}):
                    if start > end:
                        ids.append(i)
                        begins.append(start)
                        ends.append(start + length)
                    ends[-1] = end = start + length
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start", "end"])

    spans = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start int, end int")
    return spans.withColumn("n_words", F.col("end") - F.col("start"))
