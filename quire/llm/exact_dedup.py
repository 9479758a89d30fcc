"""Exact deduplication against immutable snapshots, screened by binary-fuse filters.

A snapshot is a table of buckets (digest, number of rows, largest id). For each shard
of the digest space a static binary-fuse filter is built over its buckets. An incoming
batch is first grouped by itself; its distinct digests are screened by the filter of
their shard. Digests that the filter denies are new and never touch the buckets; the
others join the exact buckets, and the texts of every group of several rows are
compared byte by byte with the text of the row that stays.

Only digests are shuffled; texts are, too, for rows in groups of several. Groups are
pre-aggregated map-side, so one text in a third of all rows costs a row per task. Rows
get their group back by a join in which frequent digests are broadcast and their rows
stay where they are; the texts of a group are compared in parts of about 256 rows, to each
of which the text that stays is sent.

Defined results: null text counts as empty; texts are equal when identical after
lower-casing A-Z only; of equal texts the row with the largest id stays. Repeated rows
(same id, same text) count in group_size and are all marked kept, since nothing tells
them apart. Rows whose bytes differ from those of the row that stays (a digest collision)
form groups of equal bytes of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import hot_from
from quire.session import in_batches, persist_table

#: Keys of one filter shard, about.
SHARD_KEYS = 16_384
#: Rows of a group that are compared with one copy of the text that stays.
PART = 256
#: Rows up to which a list of ids is broadcast (16 bytes each); beyond it is shuffled.
BROADCAST_ROWS = 1_000_000


# ---------------------------------------------------------------- binary-fuse filter


class BinaryFuse8:
    """Static filter of 8-bit fingerprints over 64-bit keys, three slots a key in neighbouring segments."""

    def __init__(self, seed: int, length: int, slots: np.ndarray) -> None:
        self.seed, self.length, self.slots = seed, length, slots

    @staticmethod
    def mix(keys: np.ndarray, seed: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            return h ^ (h >> np.uint64(33))

    @staticmethod
    def places(h: np.ndarray, length: int, total: int) -> tuple[np.ndarray, np.ndarray]:
        """The three slots (rows) and the fingerprint of each hash."""
        first = ((h >> np.uint64(32)) * np.uint64(total - 2 * length) >> np.uint64(32)).astype(np.int64)
        mask = length - 1
        segment = first // length
        second = (segment + 1) * length + ((h >> np.uint64(18)).astype(np.int64) & mask)
        third = (segment + 2) * length + (h.astype(np.int64) & mask)
        return np.stack([first, second, third]), ((h ^ (h >> np.uint64(40))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        length = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * max(1.0, math.log(1e6) / math.log(max(n, 2))))
        total = (max(1, math.ceil(n * factor / length)) + 2) * length
        for seed in range(1, 200):
            at, mark = cls.places(cls.mix(keys, seed), length, total)
            slots = cls.assign(at, mark, total)
            if slots is not None:
                return cls(seed, length, slots)
            total += length if seed % 8 == 0 else 0
        raise RuntimeError("no filter could be built")

    @staticmethod
    def assign(at: np.ndarray, mark: np.ndarray, total: int) -> np.ndarray | None:
        """Peel keys that own a slot alone, round by round; then fill in reverse order."""
        n = at.shape[1]
        alive, rounds = np.arange(n), []
        while len(alive):
            use = at[:, alive]
            alone = np.bincount(use.ravel(), minlength=total)[use] == 1
            has = alone.any(axis=0)
            if not has.any():
                return None
            own = alone.argmax(axis=0)
            rounds.append((alive[has], own[has]))
            alive = alive[~has]
        slots = np.zeros(total, np.uint8)
        for keys, own in reversed(rounds):
            use = at[:, keys]
            mine = use[own, np.arange(len(keys))]
            slots[mine] = 0
            slots[mine] = mark[keys] ^ slots[use[0]] ^ slots[use[1]] ^ slots[use[2]]
        return slots

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, mark = self.places(self.mix(keys.astype(np.uint64), self.seed), self.length, len(self.slots))
        return (self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]]) == mark

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.length], "<u4").tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse8:
        seed, length = np.frombuffer(data, "<u4", 2).tolist()
        return cls(seed, length, np.frombuffer(data, np.uint8, offset=8))


# ---------------------------------------------------------------- stages


def normalised(text_col: str):
    """Column of the text that decides equality: A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256_digest(data: bytes) -> bytes:
    from hashlib import sha256

    return sha256(data).digest()


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = sha256_digest, with_text: bool = False) -> DataFrame:
    """doc_id, digest of each row's normalised text (in UTF-8), and with_text norm, that text as bytes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lower = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
        for batch in batches:
            norm = [t.as_py().translate(lower) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(map(digest, norm), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(norm, pa.binary())] if with_text else columns, ["doc_id", "digest", "norm"][: 2 + with_text])

    return in_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary" + ", norm binary" * with_text)


def buckets(rows: DataFrame) -> DataFrame:
    """digest, n, keep_id: exact buckets of rows of (doc_id, digest)."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))


def _shard(shards: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _keys(values) -> np.ndarray:
    """64-bit keys of digests, from bytes that the shard doesn't depend on."""
    return np.frombuffer(b"".join(bytes(v)[8:16] for v in values), "<u8")


def build_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """shard, filter: a binary-fuse filter over the buckets of each shard of a snapshot."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "filter": [BinaryFuse8.build(_keys(group["digest"])).to_bytes()]})

    return snapshot.select(_shard(shards).alias("shard"), "digest").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def screen(batch: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """batch (digest, n, keep_id) with maybe: whether the filter of its shard lets the digest pass."""

    def ask(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows["maybe"] = BinaryFuse8.from_bytes(own["filter"].iloc[0]).contains(_keys(rows["digest"])) if len(own) and len(rows) else False
        return rows[["digest", "n", "keep_id", "maybe"]]

    schema = f"digest binary, n long, keep_id {batch.schema['keep_id'].dataType.simpleString()}, maybe boolean"
    return batch.withColumn("shard", _shard(shards)).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(ask, schema)


def merge_batch(snapshot: DataFrame, batch: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Buckets of the next snapshot: those of snapshot with what passes the filters and joins them, and the batch's new ones."""
    asked = persist_table(screen(batch, filters, shards), "screened")
    found = asked.filter("maybe").select("digest", F.col("n").alias("more"), F.col("keep_id").alias("later"))
    old = snapshot.join(found, "digest", "left").select("digest", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("keep_id", "later").alias("keep_id"))
    fresh = asked.filter("not maybe").drop("maybe")
    false_alarms = asked.filter("maybe").drop("maybe").join(snapshot, "digest", "left_anti")
    return old.unionByName(fresh).unionByName(false_alarms)


def unequal_rows(docs: DataFrame, members: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = sha256_digest) -> DataFrame:
    """doc_id, digest, norm (the text as bytes) of members (doc_id, digest, keep_id, n) whose text differs, byte by byte, from that of the row that stays.

    A group's rows are dealt into parts of about PART rows, each of which gets the text that stays.
    """
    members = persist_table(members.distinct(), "members")
    small = members.count() <= BROADCAST_ROWS
    ids = members.select(F.col("doc_id").alias("_member")).distinct()
    some = docs.join(F.broadcast(ids) if small else ids, F.col(id_col) == F.col("_member"), "left_semi")
    texts = digests(some, id_col=id_col, text_col=text_col, digest=digest, with_text=True)
    texts = texts.join(F.broadcast(members) if small else members, ["doc_id", "digest"]).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    keepers = texts.filter("doc_id = keep_id").groupBy("digest", "parts").agg(F.first("norm").alias("kept_text"))
    keepers = keepers.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    others = texts.filter("doc_id <> keep_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    return others.join(keepers, ["digest", "part"]).filter("norm <> kept_text").select("doc_id", "digest", "norm")


def exact_dedup(docs: DataFrame, *, incoming_share: int = 4, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = sha256_digest) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (the digest, in hex).

    The table is taken as a snapshot and a batch that comes in (one of incoming_share
    parts by a hash of the id), so that every row goes through the same steps as in
    daily use: buckets, filters, screening, exact join, byte checks.
    """
    rows = persist_table(digests(docs, id_col=id_col, text_col=text_col, digest=digest), "digests")
    coming = F.pmod(F.xxhash64("doc_id"), F.lit(incoming_share)) == 0
    snapshot = persist_table(buckets(rows.filter(~coming)), "buckets")
    shards = max(1, math.ceil(snapshot.count() / SHARD_KEYS))
    groups = persist_table(merge_batch(snapshot, buckets(rows.filter(coming)), build_filters(snapshot, shards), shards), "groups")
    several, many = groups.filter("n > 1"), hot_from(rows.count())
    hot = F.broadcast(several.filter(F.col("n") > many))
    cold = rows.join(hot, "digest", "left_anti").join(several.filter(F.col("n") <= many), "digest", "left")
    told = persist_table(rows.join(hot, "digest").unionByName(cold).select("doc_id", "digest", "n", "keep_id"), "told")
    wrong = persist_table(unequal_rows(docs, told.filter("n > 1"), id_col=id_col, text_col=text_col, digest=digest), "unequal")
    if not wrong.isEmpty():  # rows whose bytes differ from their group's form groups of equal bytes of their own
        apart = wrong.groupBy("digest", "norm").agg(F.max("doc_id").alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
        apart = wrong.join(apart, ["digest", "norm"]).select("doc_id", "digest", "own_keep", "own_n")
        fewer = wrong.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
        told = told.join(apart, ["doc_id", "digest"], "left").join(fewer, "digest", "left")
        told = told.withColumn("keep_id", F.coalesce("own_keep", "keep_id")).withColumn("n", F.coalesce("own_n", F.col("n") - F.coalesce("less", F.lit(0))))
    keep = F.coalesce("keep_id", "doc_id")
    return told.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id") == keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
