"""N-gram Jaccard self-join by chosen paths.

Each text is the set of its runs of five words; texts with the same set are one class,
represented by its least id. A set is embedded as SIZE minhash values, so that the share
of equal values estimates the Jaccard similarity. In each of several runs every set
walks down a random forest: at a node (a path) it takes each of its values that isn't on
the path yet, decided by a hash of path and value, so that similar sets take the same
ones: a pair at the threshold takes one common value on average at the root, BRANCH below
it. Sets that took the same value at the same node share a child. Children of one set end
there; small ones are compared by brute force on the embedding; large ones lose the close
surroundings of a pivot. Sets with a link to the pivot are in one group, so what is left
to find has a side that is far from the pivot: it is found by brute force in pairs of
bounded blocks where that takes at most FINISH^2 comparisons or the node is at DEPTH;
else the node is split again. So no pair of a node is dropped, at whatever level. The
number of runs follows from the target recall for pairs that meet at DEPTH only.

The links found that way join sets into candidate groups, with a margin for the error
of the estimate. Within each group the whole texts are read again, once, and every pair's
exact similarity is computed from the sets of shingle hashes, in blocks of bounded size, of
which each sends on a row per set (number of links, and a link to the least set it reaches),
never a row per pair.

Skew: a class is one row however many copies it has; a large node is split by pivots,
deeper paths and pairs of blocks; a large group is dealt into pairs of blocks. The work on a
group of n different texts remains quadratic in n, in units of two blocks of bounded size
each: to count its links where they are similar; where they only seem to be (pairs whose
estimate is within the margin below the threshold, such as pages of one template at 0.7)
it is spent without a link. The sets are shuffled n / BLOCK times.

Defined results: texts of one to four words are one shingle; null texts and texts without
a word link with nothing, nor do rows without an id (whose class is null). Repeated rows are
copies of each other; an id stands for one text. Ids may be of any type that has an order.
Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.words import WordHashes, hot_from, join_hot, mixed, shingle_set, with_texts
from quire.session import in_batches, persist_table

SIZE = 64
#: Sets that are compared by brute force at a node.
LEAF = 48
#: Sets, and bytes of their shingles, in one block of exact comparison; sets from which an element is counted by matrices.
BLOCK, BLOCK_BYTES, FEW = 512, 2 << 20, 48
#: Rows up to which a table of nodes is broadcast (about 300 bytes each).
NODES = 50_000
#: Levels of splits; nodes that are still large then are finished by brute force.
DEPTH = 6
#: Common values that a pair at the threshold takes on average at a node below the root.
BRANCH = 2
#: A large node is split if it takes more than FINISH^2 comparisons; sets in one block of them (1 MB). With blocks as
#: large as FINISH a node that isn't split is one unit or makes at most 4 rows a set, so its rows don't grow with its square.
FINISH = NODE_BLOCK = 4096


def margin_for(threshold: float) -> float:
    """Four standard deviations of the estimate of a similarity at the threshold."""
    return 4 * math.sqrt(threshold * (1 - threshold) / SIZE)


def odds_at(level: int, threshold: float) -> float:
    """Probability with which a set takes one of its SIZE - level values that aren't on the path."""
    return min(1.0, (BRANCH if level else 1) / max(threshold * SIZE - level, 1e-9))


def runs_for(recall: float, threshold: float = 0.8, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met at the given depth with the given probability.

    Pairs that meet higher up have met more often. The number of the pair's equal values is
    binomial; the mean is taken over those whose estimate is within margin_for, as others
    aren't linked anyway (0.013 % at 0.8).
    """
    least = (threshold - margin_for(threshold)) * SIZE
    missed = []
    for equal in range(SIZE + 1):
        met = 1.0
        for level in range(depth, -1, -1):
            met = 1 - (1 - odds_at(level, threshold) * met) ** max(equal - level, 0)
        if equal and equal >= least:
            missed.append((math.comb(SIZE, equal) * threshold**equal * (1 - threshold) ** (SIZE - equal), 1 - met))
    runs, every = 1, sum(p for p, _ in missed)
    while sum(p * m**runs for p, m in missed) > (1 - recall) * every:
        runs += 1
    return runs


def _seeds(n: int, salt: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def embed(shingles: np.ndarray) -> np.ndarray:
    """SIZE minhash values of 32 bits."""
    with np.errstate(over="ignore"):
        a, b = _seeds(SIZE, 11) | np.uint64(1), _seeds(SIZE, 13)
        best = np.full(SIZE, 0xFFFFFFFFFFFFFFFF, np.uint64)
        for at in range(0, len(shingles), 1024):
            h = shingles[at : at + 1024, None] * a + b
            best = np.minimum(best, h.min(axis=0))
        return (mixed(best) >> np.uint64(32)).astype(np.uint32)


def embedded(docs: DataFrame, *, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, set_key (of the set of shingles), n (its size), values (the embedding) of the texts that have a word."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        from hashlib import blake2b

        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            keep, key, n, values = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = shingle_set(hashes.of(t.as_py()), words)
                if len(own):
                    keep.append(i)
                    key.append(blake2b(own.tobytes(), digest_size=16).digest())
                    n.append(len(own))
                    values.append(embed(own).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, batch.schema.field(0).type), pa.array(key, pa.binary()), pa.array(n, pa.int32()), pa.array(values, pa.binary())], ["doc_id", "set_key", "n", "values"])

    return in_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, set_key binary, n int, values binary")


# ---------------------------------------------------------------- paths


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIZE)


def take_paths(sets: DataFrame, runs: int | None, threshold: float, level: int = 0) -> DataFrame:
    """path, used, rep: the children that each set goes to, from the root of each run, or (runs None) from its own path at level - 1.

    used: the positions of the values on the path, as bits.
    """
    odds = np.uint64(odds_at(level, threshold) * 2**32)
    seeds = [None] if runs is None else list(_seeds(runs, 17))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = _matrix(batch.column("values")).astype(np.uint64)
            tagged = mixed(values + (np.arange(SIZE, dtype=np.uint64) << np.uint64(32)))
            reps, paths, masks, outs = batch.column("rep").to_numpy(zero_copy_only=False), [], [], []
            bits = np.uint64(1) << np.arange(SIZE, dtype=np.uint64)
            used = np.zeros(len(reps), np.uint64) if runs else np.asarray(batch.column("used")).astype(np.int64).view(np.uint64)
            free = (used[:, None] & bits) == 0
            for seed in seeds:
                above = np.asarray(batch.column("path")).astype(np.int64).view(np.uint64)[:, None] if seed is None else seed
                with np.errstate(over="ignore"):
                    h = mixed(tagged * np.uint64(0xD6E8FEB86659FD93) + above)
                row, at = np.nonzero(((h & np.uint64(0xFFFFFFFF)) < odds) & free)
                paths.append(h[row, at].view(np.int64))
                masks.append((used[row] | bits[at]).view(np.int64))
                outs.append(reps[row])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths), pa.int64()), pa.array(np.concatenate(masks), pa.int64()), pa.array(np.concatenate(outs), batch.schema.field("rep").type)], ["path", "used", "rep"])

    return sets.mapInArrow(run, f"path long, used long, rep {sets.schema['rep'].dataType.simpleString()}").distinct()


def leaf_links(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) within the nodes of rows (path, rep, values), by brute force; nodes have at most LEAF sets.

    Rows are streamed by path; memory holds one batch and one node. Links are reduced to
    one per set and node, to the least set that links lead to.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def links(path: np.ndarray, rep: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            left, right = [], []
            for shift in range(1, LEAF):
                at = np.flatnonzero(path[shift:] == path[:-shift]) if len(path) > shift else np.zeros(0, int)
                if not len(at):
                    break
                at = at[(values[at] == values[at + shift]).sum(axis=1) >= least * SIZE]
                left.append(at)
                right.append(at + shift)
            a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
            label = _least_labels(len(path), a, b)
            moved = np.flatnonzero(label != np.arange(len(path)))
            return rep[moved], rep[label[moved]]

        held: tuple | None = None
        kind = None
        for batch in batches:
            if not len(batch):
                continue
            kind = batch.schema.field("rep").type
            now = (np.asarray(batch.column("path")), np.asarray(batch.column("rep")), _matrix(batch.column("values")))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last node may go on in the next batch
            held = tuple(x[cut:] for x in now)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in links(*(x[:cut] for x in now))], ["a", "b"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in links(*held)], ["a", "b"])

    kind = rows.schema["rep"].dataType.simpleString()
    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index that the links (a, b) lead to from each of n."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def pivot_links(rows: DataFrame, level: int, least: float, core: float, wide: float) -> DataFrame:
    """rows (path, used, rep, values) of large nodes with pivot and near.

    near: 3 if what links with the set links with the pivot too, 2 if the set is linked to the
    pivot, 1 if it isn't but might share a link with sets that are 3, 0 otherwise.
    """
    kind = rows.schema["rep"].dataType.simpleString()
    pivots = rows.groupBy("path").agg(F.min_by(F.struct("rep", "values"), F.xxhash64("rep", F.lit(level))).alias("p")).select("path", F.col("p.rep").alias("pivot"), F.col("p.values").alias("pivot_values"))
    pivots = persist_table(pivots, "pivots")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            same = (_matrix(batch.column("values")) == _matrix(batch.column("pivot_values"))).sum(axis=1) / SIZE if len(batch) else np.zeros(0)
            near = (same >= core).astype(np.int8) + (same >= least) + (same >= wide)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "used", "rep", "values", "pivot")), pa.array(near.astype(np.int32))], ["path", "used", "rep", "values", "pivot", "near"])

    return rows.join(_if_few(pivots), "path").mapInArrow(run, f"path long, used long, rep {kind}, values binary, pivot {kind}, near int")


def _if_few(nodes: DataFrame) -> DataFrame:
    """A table of nodes, broadcast if it has at most NODES rows; beyond that, joins shuffle and split skewed partitions."""
    return F.broadcast(nodes) if nodes.count() <= NODES else nodes


def block_pairs(rows: DataFrame) -> DataFrame:
    """path, i, j, own, far, rep, values: rows (path, rep, values, far, size, n_far) of nodes, once for each pair of blocks with far sets that their own is in.

    Far sets are dealt into blocks of about NODE_BLOCK and so are the others (of a small node all into one).
    """
    small = F.col("size") <= NODE_BLOCK
    far_blocks = F.when(small, 1).otherwise(F.ceil(F.col("n_far") / NODE_BLOCK)).cast("int")
    near_blocks = F.when(small, 0).otherwise(F.ceil((F.col("size") - F.col("n_far")) / NODE_BLOCK)).cast("int")
    dealt = F.xxhash64("rep", F.lit(29))
    own = F.when(small, 0).when(F.col("far"), F.pmod(dealt, F.col("far_blocks"))).otherwise(F.col("far_blocks") + F.pmod(dealt, F.col("near_blocks"))).cast("int")
    rows = rows.withColumn("far_blocks", far_blocks).withColumn("near_blocks", near_blocks).withColumn("own", own)
    last = F.col("far_blocks") - 1 + F.when(F.col("far"), F.col("near_blocks")).otherwise(0)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "far", "rep", "values")


def block_links(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) within nodes of any size of rows (path, rep, values, far, size, n_far), between sets of which one is far at least.

    Each pair of blocks with far sets is a task's unit. Links are reduced as in leaf_links.
    """
    rows = block_pairs(rows)
    kind = rows.schema["rep"].dataType.simpleString()

    def compare(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values("rep", kind="stable")
        values = np.frombuffer(b"".join(unit["values"]), np.uint32).reshape(-1, SIZE)
        far, own, reps = unit["far"].to_numpy(bool), unit["own"].to_numpy(), unit["rep"].to_numpy()
        crossed = unit["i"].iloc[0] != unit["j"].iloc[0]
        one = np.flatnonzero(far & (own == own.min()))
        two = np.flatnonzero(own != own.min()) if crossed else np.arange(len(reps))
        left, right = [], []
        columns = np.ascontiguousarray(values[two].T)
        for begin in range(0, len(one), 256):
            at = one[begin : begin + 256]
            same = np.zeros((len(at), len(two)), np.uint8)
            for k in range(SIZE):
                same += values[at, k][:, None] == columns[k]
            a, b = np.nonzero(same >= least * SIZE)
            left.append(at[a])
            right.append(two[b])
        label = _least_labels(len(reps), *(np.concatenate(x) if x else np.zeros(0, int) for x in (left, right)))
        moved = np.flatnonzero(label != np.arange(len(reps)))
        return pd.DataFrame({"a": reps[moved], "b": reps[label[moved]]})

    return rows.groupBy("path", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def _counted(rows: DataFrame) -> DataFrame:
    """rows with size and n_far of their nodes, without nodes that have no pair with a far set."""
    nodes = persist_table(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.count_if("far").alias("n_far")).filter("n_far > 0 and size > 1"), "nodes")
    return rows.join(_if_few(nodes), "path")


def candidate_links(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Links (a, b) between sets (rep, values) whose estimated similarity is near the threshold or above.

    Every level's paths, nodes and links are written as tables, so no plan spans two levels.
    """
    margin = margin_for(threshold)
    least = threshold - margin
    core, wide = 1 - (1 - threshold) / 4, max(0.0, 1 - (1 - threshold) * 1.25 - 1.5 * margin)
    out: list[DataFrame] = []

    def found(links: DataFrame) -> None:
        out.append(persist_table(links, "links"))

    paths = take_paths(reps, runs_for(recall, threshold), threshold)
    for level in range(DEPTH + 1):
        paths = persist_table(paths, "paths")
        size = persist_table(paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
        rows = persist_table(join_hot(paths, size, ["path"], "size", hot_from(paths.count())).join(reps.select("rep", "values"), "rep"), "nodes")
        found(leaf_links(rows.filter(F.col("size") <= LEAF).select("path", "rep", "values"), least))
        large = rows.filter(F.col("size") > LEAF).select("path", "used", "rep", "values")
        if large.isEmpty():
            break
        split = persist_table(pivot_links(large, level, least, core, wide), "split")
        found(split.filter("near > 1 and pivot <> rep").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct())
        nodes = _counted(split.withColumn("far", F.col("near") < 2))
        ends = F.lit(level == DEPTH) | (F.col("n_far") * F.col("size") <= FINISH * FINISH)
        found(block_links(nodes.filter(ends), least))
        on = nodes.filter(~ends).drop("far", "size", "n_far")
        if level == DEPTH or on.isEmpty():
            break
        # sets that link with the pivot as closely as can be go no further, but for the pairs that the pivot doesn't speak for
        found(block_links(_counted(on.filter("near in (1, 3)").withColumn("far", F.col("near") == 1)).filter("n_far < size"), least))
        paths = take_paths(on.filter("near < 3").select("path", "used", "rep", "values"), None, threshold, level + 1)
    every = out[0]
    for links in out[1:]:
        every = every.unionByName(links)
    return every


# ---------------------------------------------------------------- exact verification


def shingle_table(texts: DataFrame, words: int) -> DataFrame:
    """rep, copies, grp, shingles (sorted 64-bit hashes) of rows (rep, text, copies, grp)."""
    kind = texts.schema["rep"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(hashes.of(t.as_py()), words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "copies", "grp")), pa.array(sets, pa.binary())], ["rep", "copies", "grp", "shingles"])

    return texts.select("rep", "copies", "grp", "text").mapInArrow(run, f"rep {kind}, copies long, grp {kind}, shingles binary")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of common elements of any two of the sets (whose elements are distinct).

    Elements of fewer than FEW sets are counted by their pairs of sets, others by products of 0-1 matrices.
    """
    n = len(sets)
    which = np.repeat(np.arange(n), [len(s) for s in sets])
    element = np.concatenate(sets)
    order = np.argsort(element, kind="stable")
    element, which = element[order], which[order]
    begin = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1])))
    times = np.diff(np.append(begin, len(element)))
    of = np.repeat(times, times)
    common = np.zeros(n * n, np.float32)
    rare = (of > 1) & (of < FEW)
    own, sets_of, size = element[rare], which[rare], of[rare]
    for shift in range(1, min(FEW, int(size.max(initial=0)))):
        at = np.flatnonzero(own[shift:] == own[:-shift])
        np.add.at(common, sets_of[at] * n + sets_of[at + shift], np.float32(1))
    common = common.reshape(n, n)
    common += common.T
    often = np.flatnonzero(times >= FEW)
    for at in range(0, len(often), 4096):
        some = often[at : at + 4096]
        part = np.zeros((n, len(some)), np.float32)
        for k, x in enumerate(some):
            part[which[begin[x] : begin[x] + times[x]], k] = 1
        common += part @ part.T
    return common


def exact_links(sets: DataFrame, threshold: float) -> DataFrame:
    """rep, links, b: number of rows whose text is similar to that of rep, and the least set reached, by task.

    sets: rep, copies, grp, shingles. Groups are dealt into blocks of at most about BLOCK sets and
    BLOCK_BYTES of shingles, and each pair of blocks is a task's unit, so no unit holds more than two blocks.
    """
    sizes = sets.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("shingles")).alias("bytes"))
    sizes = sizes.select("grp", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    kind = sets.schema["rep"].dataType.simpleString()
    several = persist_table(sizes.filter("blocks > 1"), "blocks")
    few = several.count() <= NODES
    rows = sets.join(F.broadcast(several) if few else several, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(31)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "shingles")

    def compare(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values("rep", kind="stable").drop_duplicates("rep")  # rows of one id are one text
        own = [np.frombuffer(b, np.uint64) for b in unit["shingles"]]
        size = np.array([len(s) for s in own])
        common = common_counts(own)
        linked = np.zeros(common.shape, bool)
        for at in range(0, len(own), 128):  # rows by rows: exact numbers take twice the memory
            part = common[at : at + 128].astype(float)
            linked[at : at + 128] = part >= threshold * (size[at : at + 128, None] + size[None, :] - part) - 1e-6
        np.fill_diagonal(linked, False)
        if unit["i"].iloc[0] != unit["j"].iloc[0]:
            side = unit["own"].to_numpy()
            linked &= side[:, None] != side[None, :]
        reps = unit["rep"].to_numpy()
        label = _least_labels(len(reps), *np.nonzero(linked))
        out = pd.DataFrame({"rep": reps, "links": linked @ unit["copies"].to_numpy(np.int64), "b": reps[label]})
        return out[(out["links"] > 0)]

    return rows.groupBy("grp", "i", "j").applyInPandas(compare, f"rep {kind}, links long, b {kind}")


def jaccard_join(docs: DataFrame, *, threshold: float = 0.8, words: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, rep_id, n_shingles.

    n_links: other rows with a similarity of threshold or more; class_id: the least id
    that such links lead to; rep_id: the least id with the same set of shingles.
    """
    rows = persist_table(embedded(docs.filter(F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col, words=words), "embedded")
    reps = persist_table(rows.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.first("values").alias("values")), "reps")
    groups = components(candidate_links(reps, threshold, recall))
    members = persist_table(groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")).join(reps.select("rep", "copies"), "rep"), "members")
    texts = with_texts(docs, members.withColumnRenamed("rep", "doc_id"), id_col=id_col, text_col=text_col).withColumnRenamed("doc_id", "rep")
    found = persist_table(exact_links(persist_table(shingle_table(texts, words), "sets"), threshold), "links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.filter("rep <> b").select(F.col("rep").alias("a"), "b"))
    known = reps.select("set_key", "rep", "copies", "n").join(linked, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("set_key", "rep", "n", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    every = docs.select(F.col(id_col).alias("doc_id"))
    alone = every.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("rep_id"), F.lit(0).alias("n_shingles"))
    return rows.select("doc_id", "set_key").join(known, "set_key").select("doc_id", "class_id", "n_links", F.col("rep").alias("rep_id"), F.col("n").alias("n_shingles")).unionByName(alone)
