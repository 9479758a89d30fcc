"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the set of hashed
words of a text, so that a pair of words (an insult and the mention of a group, say)
can weigh more than its parts. Linear weights are trained by follow-the-regularised-
leader with an L1 penalty, which sets the weight of the mass of ordinary words to zero;
factors belong to a word only while its linear weight is not zero and enough training
rows have it, so long texts don't drown in noise. Scoring looks words up in the task
that reads a row; nothing is shuffled. Only the labels' side of the training join, of
bounded size, is broadcast.

Defined results: null and empty texts score as texts without terms; rows without a
label are only scored; of several labels of one id the largest counts; without any
labelled row every score is 0. Repeated rows give repeated rows, empty tables none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import in_batches

BITS = 20


def words(text: str | None) -> set[str]:
    """Lower-cased words of a text."""
    return set(re.findall(r"\w+", text.lower())) if text else set()


def terms(word: str) -> list[str]:
    """A word's terms: itself and, of longer ones, the beginning, which compounds and inflections keep."""
    return [word, *(f"{word[:k]}-" for k in (4, 5) if len(word) > k)]


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) >> (32 - BITS)


class FactorizationMachine:
    """Weights and factors of the buckets that have any."""

    def __init__(self, bias: float, weights: dict[int, float], factors: dict[int, np.ndarray], rank: int) -> None:
        self.bias, self.weights, self.factors, self.rank = bias, weights, factors, rank
        self._row = {b: i for i, b in enumerate(weights)}
        self._w = np.array([*weights.values()], float)
        self._v = np.array([factors.get(b, np.zeros(rank)) for b in weights], float).reshape(len(weights), rank)
        self._known: dict[str, int] = {}

    def rows_of(self, text: str | None) -> list[int]:
        """Rows of the terms of a text that have a weight."""
        known, out = self._known, set()
        if len(known) > 250_000:
            known.clear()
        for w in words(text):
            rows = known.get(w)
            if rows is None:
                rows = known[w] = tuple(self._row[b] for b in map(bucket, terms(w)) if b in self._row)
            if rows:
                out.update(rows)
        return sorted(out)

    def score(self, text: str | None) -> float:
        rows = self.rows_of(text)
        s = self.bias
        if rows:
            v = self._v[rows]
            s += self._w[rows].sum() + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def train_fm(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, *, rank: int = 8, epochs: int = 4, alpha: float = 0.3, l1: float = 3.0, l2: float = 0.5, least: int = 5, rate: float = 0.05, decay: float = 0.01, seed: int = 5) -> FactorizationMachine:
    """rows: arrays of distinct buckets; weight: of each row in the loss.

    least: rows that must have a bucket before it gets any weight.
    """
    every, at = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.int64), return_inverse=True)
    often = np.bincount(at, minlength=len(every)) >= least
    edge = np.cumsum([0, *map(len, rows)])
    own = [a[often[a]] for a in (at[edge[i] : edge[i + 1]] for i in range(len(rows)))]
    rng = np.random.default_rng(seed)
    z, n = np.zeros(len(every)), np.zeros(len(every))
    v, m = rng.normal(0, 0.01, (len(every), rank)), np.full((len(every), rank), 1e-6)
    bias, bias_n = 0.0, 1.0
    for _ in range(epochs):
        for i in rng.permutation(len(own)):
            used = own[i]
            zu, nu = z[used], n[used]
            w = np.where(np.abs(zu) > l1, (np.sign(zu) * l1 - zu) / ((1.0 + np.sqrt(nu)) / alpha + l2), 0.0)
            live = used[w != 0]
            vl = v[live]
            total = vl.sum(axis=0)
            s = bias + w.sum() + 0.5 * float(total @ total - (vl * vl).sum())
            g = weight[i] * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[i])
            more = nu + g * g
            z[used] = zu + g - (np.sqrt(more) - np.sqrt(nu)) / alpha * w
            n[used] = more
            bias_n += g * g
            bias -= 0.3 * g / np.sqrt(bias_n)
            if len(live) > 1:
                step = g * (total - vl) + decay * vl
                m[live] += step * step
                v[live] = vl - rate * step / np.sqrt(m[live] + 1e-8)
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((1.0 + np.sqrt(n)) / alpha + l2), 0.0)
    live = np.flatnonzero(w)
    return FactorizationMachine(bias, {int(every[k]): float(w[k]) for k in live}, {int(every[k]): v[k] for k in live}, rank)


# ---------------------------------------------------------------- Spark


def train(docs: DataFrame, labels: DataFrame, training: Column, *, per_label: int = 4_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine | None:
    """Fit on the labelled rows for which training (an expression of doc_id) holds; None without any.

    About per_label rows of each label at most are used, chosen by a hash of the id;
    so the labels that are broadcast, and the rows of the one task that fits, are bounded;
    only the model comes to the driver.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().filter(training).groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return None
    share = {k: min(1.0, per_label / n) for k, n in counts.items()}
    own = F.when(F.col("y") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) < own * 1_000_003)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            used = [np.array(sorted({bucket(x) for w in words(t.as_py()) for x in terms(w)}), np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(used, pa.list_(pa.int32())), batch.column(2)], ["doc_id", "used", "y"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    sampled = in_batches(picked).mapInArrow(run, f"doc_id {kind}, used array<int>, y int").repartition(1)

    def fit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        got = [b for b in batches if len(b)]
        if not got:
            return
        table = pa.Table.from_batches(got).sort_by("doc_id")
        lists = table["used"].combine_chunks()  # as flat arrays: lists of Python numbers would take more memory
        flat, edge = lists.values.to_numpy(), lists.offsets.to_numpy()
        often = np.bincount(flat, minlength=1 << BITS) >= 5
        rows = [own[often[own]] for own in (flat[edge[i] : edge[i + 1]] for i in range(len(lists)))]
        y = table["y"].to_numpy().astype(float)
        weight = np.where(y == 1, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0))
        m = train_fm(rows, y, weight / weight.mean())
        keys = np.array([*m.weights], np.int64)
        yield pa.RecordBatch.from_pydict({"bias": [m.bias], "rank": pa.array([m.rank], pa.int32()), "keys": [keys.tobytes()], "weights": [m._w.tobytes()], "factors": [m._v.tobytes()]})

    made = sampled.mapInArrow(fit, "bias double, rank int, keys binary, weights binary, factors binary").collect()
    if not made:
        return None
    keys, w = np.frombuffer(made[0]["keys"], np.int64).tolist(), np.frombuffer(made[0]["weights"])
    v = np.frombuffer(made[0]["factors"]).reshape(len(keys), made[0]["rank"])
    return FactorizationMachine(made[0]["bias"], dict(zip(keys, w.tolist(), strict=True)), dict(zip(keys, v, strict=True)), made[0]["rank"])


def score(docs: DataFrame, model: FactorizationMachine | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of each row's whole text; only the text is looked at."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [model.score(t.as_py()) if model else 0.0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = in_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
