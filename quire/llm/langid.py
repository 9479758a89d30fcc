"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased text, with
everything but letters taken as one space; term frequencies are damped by a logarithm,
weighted by the inverse document frequency and scaled to unit length. Document
frequencies are counted over all training rows, in one pass that sends one row per used
bucket and task. The weights are trained by follow-the-regularised-leader with
elastic-net (L1 + L2) penalties, on a sample whose size a parameter bounds, and the
scores are calibrated by a temperature fitted on a part of the sample left out of the
training. Prediction runs in the task that reads a row; nothing is shuffled.

Defined results: a null text or one without a letter is `und` with score 0; so is
every text where no labelled row exists. Empty tables give empty results; repeated rows
repeated ones. Training rows with null text or without letters are passed over.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import in_batches

BITS = 15
BUCKETS = 1 << BITS


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.frombuffer(bytes(unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool)


def grams(text: str) -> np.ndarray | None:
    """Hashed n-grams (1 to 3) of a whole text, repeats included; None without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    word = letters()[code]
    if not word.any():
        return None
    code = np.where(word, code, np.uint32(32))
    code = code[np.concatenate(([True], word[1:] | word[:-1]))]  # runs of others: one space
    code = np.concatenate(([32], code, [32])).astype(np.uint32)
    shift = np.uint32(32 - BITS)
    one = code * np.uint32(2654435761)
    two = (one[:-1] ^ (one[1:] >> np.uint32(3)) ^ (code[1:] << np.uint32(7))) * np.uint32(2246822519)
    three = (two[:-1] ^ (one[2:] >> np.uint32(5)) ^ (code[2:] << np.uint32(11))) * np.uint32(3266489917)
    return np.concatenate((one >> shift, two >> shift, three >> shift))


def features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(bucket, damped frequency), or None without a letter."""
    found = grams(text)
    if found is None:
        return None
    count = np.bincount(found, minlength=BUCKETS)
    used = np.flatnonzero(count)
    return used.astype(np.int32), np.log1p(count[used]).astype(np.float32)


class Model:
    """Weights, inverse document frequencies, labels and temperature."""

    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0) -> None:
        self.labels, self.idf, self.weights, self.temperature = labels, idf, weights, temperature

    def logits(self, used: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[used]
        x /= np.sqrt(x @ x) or 1.0
        return x @ self.weights[used]

    def predict(self, text: str | None) -> tuple[str, float]:
        got = features(text) if text and self.labels else None
        if got is None:
            return "und", 0.0
        z = self.logits(*got) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: list[str], idf: np.ndarray, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, epochs: int = 4, seed: int = 7) -> Model:
    """FTRL-proximal over the rows; the weights follow in closed form from z and n, and are sparse by l1."""
    z = np.zeros((BUCKETS, len(labels)))
    n = np.zeros((BUCKETS, len(labels)))

    def closed(used: np.ndarray | slice) -> np.ndarray:
        zu = z[used]
        w = (np.sign(zu) * l1 - zu) / ((beta + np.sqrt(n[used])) / alpha + l2)
        return np.where(np.abs(zu) > l1, w, 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            used, tf = rows[i]
            x = tf * idf[used]
            x = x / (np.sqrt(x @ x) or 1.0)
            w = closed(used)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = np.outer(x, p)
            more = n[used] + g * g
            z[used] += g - (np.sqrt(more) - np.sqrt(n[used])) / alpha * w
            n[used] = more
    return Model(labels, idf, closed(slice(None)).astype(np.float32))


def fit_temperature(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> float:
    """Temperature of least negative log-likelihood, by golden-section search on its logarithm.

    The labels are smoothed as if one more row had been wrong, so that rows told apart
    without an error don't drive the temperature to zero.
    """
    if not len(rows) or len(model.labels) < 2:
        return 1.0
    smooth = 1 / (len(rows) + 2)
    z = np.array([model.logits(*r) for r in rows], float)

    def loss(t: float) -> float:
        s = z / np.exp(t)
        s -= s.max(axis=1, keepdims=True)
        right = s[np.arange(len(y)), y]
        wrong = (s.sum(axis=1) - right) / (s.shape[1] - 1)
        return float((np.log(np.exp(s).sum(axis=1)) - (1 - smooth) * right - smooth * wrong).mean())

    a, b, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


# ---------------------------------------------------------------- Spark


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Rows that have each bucket, and rows in all, over every text of a one-column table."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                found = grams(t.as_py() or "")
                if found is not None:
                    total[np.unique(found) if len(found) < 2000 else np.flatnonzero(np.bincount(found, minlength=BUCKETS))] += 1
                    rows += 1
        if rows:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([rows, *total[used].tolist()], pa.int64())], ["bucket", "n"])

    counted = in_batches(texts).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS + 1 rows
    df, rows = np.zeros(BUCKETS, np.int64), 0
    for r in counted:
        if r["bucket"] < 0:
            rows = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, rows


def train(docs: DataFrame, training: Column, *, per_label: int = 1500, most: int = 48_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Fit on the rows for which training holds and text and label aren't null.

    Document frequencies come from all of them; weights and temperature from about
    per_label rows of each label, fewer if labels are so many that it would be more than most
    rows in all, chosen by a hash of the id.
    """
    rows = docs.filter(training).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).dropna(subset=["text", "label"])
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    labels = sorted(counts)
    if not labels:
        return Model([], np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, 1), np.float32))
    df, total = document_frequencies(rows.select("text"))
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    share, per_label = F.lit(0.0), min(per_label, max(1, most // len(labels)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    for label, n in counts.items():
        share = F.when(F.col("label") == label, min(1.0, per_label / n)).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) < share * 1_000_003)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, own, used, tf = [], [], [], []
            for i, t, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                got = features(t.as_py())
                if got is not None:
                    ids.append(i)
                    own.append(label)
                    used.append(got[0])
                    tf.append(got[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(own, pa.string()), pa.array(used, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.float32()))], ["doc_id", "label", "used", "tf"])

    picked = in_batches(sample).mapInArrow(run, f"doc_id {kind}, label string, used array<int>, tf array<float>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    lists = [picked[c].combine_chunks() for c in ("used", "tf")]  # as flat arrays: lists of Python numbers would take the driver's memory
    flat, edge = [x.values.to_numpy() for x in lists], lists[0].offsets.to_numpy()
    data = [(flat[0][a:b], flat[1][a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    y = np.array([labels.index(label) for label in picked["label"].to_pylist()], int)
    left_out = np.arange(len(y)) % 5 == 4
    model = train_ftrl([d for d, out in zip(data, left_out, strict=True) if not out], y[~left_out], labels, idf)
    model.temperature = fit_temperature(model, [d for d, out in zip(data, left_out, strict=True) if out], y[left_out])
    return model


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row's whole text; only the text is looked at."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return in_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
