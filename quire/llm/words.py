"""Hashed words and word shingles, and small tables joined to texts."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of ids is broadcast (some tens of bytes a row); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash, the same on every machine; bounded in entries and in their length."""

    def __missing__(self, word: str) -> int:
        import xxhash

        out = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 250_000:
                self.clear()
            self[word] = out
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the lower-cased words of a whole text, in order."""
        found = re.findall(r"\w+", text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by doubling: no cost in k but a logarithm."""
    with np.errstate(over="ignore"):
        have, h, out, at, n = 1, words, None, 0, len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        while True:
            if k & have:
                part = h[at : at + n]
                out = part if out is None else mixed(out * _BASE + part)
                at += have
            if have * 2 > k:
                return mixed(out + np.uint64(k))
            h = mixed(h[:-have] * _BASE + h[have:]) if len(h) > have else h[:0]
            have *= 2


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; a shorter text is one shingle of all its words, none if it has no word."""
    if len(words) == 0:
        return words
    return np.unique(windows(words, min(k, len(words))))


def hot_from(rows: int) -> int:
    """Rows from which a key counts as frequent in a table of rows: there are 100,000 such keys at most."""
    return max(256, math.ceil(rows / 100_000))


def join_hot(left: DataFrame, right: DataFrame, key: list[str], n: str, many: int) -> DataFrame:
    """left joined to right, which has a row a key and in column n the number of left's rows (about).

    Keys of more than many rows are broadcast with their rows of right, so that their rows of left
    stay where they are; the others are shuffled. many bounds what is broadcast (hot_from).
    """
    hot, rest = right.filter(F.col(n) > many), right.filter(F.col(n) <= many)
    cold = left.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(cold.join(rest, key))


def with_texts(docs: DataFrame, ids: DataFrame, *, id_col: str, text_col: str, wide: bool = False) -> DataFrame:
    """Rows of ids (doc_id, ...) with the text of that doc_id, null as empty; ids identify texts.

    If ids has at most BROADCAST_ROWS rows it is broadcast (wide: only its doc_ids are),
    and no other texts are shuffled; beyond that both sides are, by doc_id.
    """
    small = ids.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not small:
        return texts.join(ids, "doc_id")
    if not wide:
        return texts.join(F.broadcast(ids), "doc_id")
    return texts.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").join(ids, "doc_id")


def ascii_table(kept: str) -> bytes:
    """For bytes.translate: A-Z become small, ASCII characters outside kept become blanks, bytes of other characters stay.

    Of UTF-8 so translated, split() gives the maximal runs of kept and non-ASCII characters.
    """
    fold = bytes(range(256)).lower()
    return bytes(c if c >= 128 or chr(c) in kept else 32 for c in fold)
