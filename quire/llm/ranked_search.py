"""Ranked lexical search over impact-ordered postings, score at a time.

Texts are read once: each gives its length and the frequencies of the terms that some item
asks for, a row a text, written as a table. From that table come document frequencies, the
weights of terms, and the scores. A task takes the rows that it reads in blocks of bounded
size. In a block the postings of each term are ordered by their exact impact, greatest first;
an item's lists are then processed together, all postings above a falling level of
contribution before those below it. After each level, what any list may still add is known;
the sum of these bounds the score of every text of which no more is seen. Texts that can't
reach the least score that still counts are out, and once few are left the loop stops and
their scores are completed from their own rows. So every score that is returned is complete.

The least score that counts for an item is the k-th best of all that this task has seen, or
of a first search over a part of the rows that is dealt by hash, whichever is greater: both
are bounds on the k-th best of all, so they spare work and never change a result. A task passes
on at most k rows an item, and only those which reach that score; the ranks are then taken over
these by a window whose k is applied before the shuffle.

Items are taken in batches of bounded bytes, one after the other, so that neither the driver
nor a task holds more than one batch of an unbounded set of items. The terms of a batch and
their weights are what is sent to all tasks.

Skew: nothing is shuffled by term or by source, so no frequent term or source gathers.

Defined results: null texts and texts without a term count for nothing and are never found.
Documents are rows: one that is there twice counts and is found twice. Rows of one item_id are
one item with all their terms, equal rows only once; an item whose id is null is one, too. Null
doc_ids come first among equal scores. Fewer than k texts with a score above 0 give fewer rows.
Empty tables give no rows.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.words import ascii_table
from quire.session import in_batches, persist_table

#: Bytes of items' texts in a batch.
BATCH_BYTES = 16 << 20
#: Texts, and postings from which on a block is closed.
BLOCK, BLOCK_POSTINGS = 16_384, 2_000_000
#: Texts in the first search, about; one of so many rows at least is dealt to it.
FIRST = 20_000
#: Levels of a search fall by this factor; it stops when at most so many texts may still count.
FALL, FEW = 0.6, 64

_TERMS = ascii_table(string.ascii_letters + string.digits)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_TERMS).split()


@dataclass
class Items:
    """Items of a batch over numbered terms, whose weights are set when the texts are counted."""

    ids: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    number: dict[bytes, int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        """Of (item id, text), equal ids taken together."""
        counts: dict = {}
        for i, text in rows:
            counts.setdefault(i, Counter()).update(terms_of((text or "").encode()))
        number: dict[bytes, int] = {}
        for own in counts.values():
            for t in own:
                number.setdefault(t, len(number))
        return Items(list(counts), [np.array([number[t] for t in own], np.int64) for own in counts.values()], [np.array(list(own.values()), np.int64) for own in counts.values()], number)


def term_frequencies(docs: DataFrame, items: Items, *, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms), terms, tf (numbers and frequencies of the items' terms, as int32) of the texts that have a term."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    number = items.number

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep, n, terms, tf = [], [], [], []
            for at, text in enumerate(batch.column(1).cast(pa.binary())):
                words = terms_of(text.as_py())
                if not words:
                    continue
                known = Counter(map(number.get, words))
                known.pop(None, None)
                keep.append(at)
                n.append(len(words))
                terms.append(np.fromiter(known.keys(), np.int32, len(known)).tobytes())
                tf.append(np.fromiter(known.values(), np.int32, len(known)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "terms", "tf"])

    return in_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms binary, tf binary")


def document_frequencies(rows: DataFrame, terms: int) -> np.ndarray:
    """Number of texts with each of the numbered terms: an array a task, added up."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out = np.zeros(terms, np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            out += np.bincount(found, minlength=terms)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at])], ["term", "df"])

    df = np.zeros(terms, np.int64)
    for row in rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row.term] = row.df
    return df


def weights_of(df: np.ndarray, texts: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts_of(tf: np.ndarray, n: np.ndarray, texts: int, length: int) -> np.ndarray:
    """Impacts of frequencies tf in texts of n terms."""
    if len(n) and int(n.max()) * 25 * texts >= 2**63:
        m = np.array([(25 * int(x) * texts) // length for x in n], np.int64)
    else:
        m = (25 * n * texts) // length
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + m))


class Block:
    """Postings of some texts, by text and by falling impact."""

    def __init__(self, ids, n: np.ndarray, terms: list[bytes], tf: list[bytes], texts: int, length: int, known: int):
        import pyarrow.compute as pc

        self.ids = ids
        order = np.empty(len(ids), np.int64)
        order[np.asarray(pc.array_sort_indices(ids, null_placement="at_start"))] = np.arange(len(ids))
        self.order = order  # place of each text among all, by id
        sizes = np.array([len(t) // 4 for t in terms], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        self.term = np.frombuffer(b"".join(terms), np.int32)
        text = np.repeat(np.arange(len(n)), sizes)
        self.impact = impacts_of(np.frombuffer(b"".join(tf), np.int32).astype(np.int64), n[text], texts, length)
        by = np.lexsort((-self.impact, self.term))
        self.list_text, self.list_impact = text[by], self.impact[by]
        self.falling = -self.list_impact
        self.list_begin = np.searchsorted(self.term[by], np.arange(known + 1))

    def complete(self, some: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """Whole scores of some texts, from their own rows; factor: weight times occurrences in the item of each term."""
        sizes = self.begin[some + 1] - self.begin[some]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[some] - (ends - sizes), sizes)
        sums = np.concatenate(([0], np.cumsum(factor[self.term[at]] * self.impact[at])))
        return sums[ends] - sums[ends - sizes]

    def search(self, terms: np.ndarray, factors: np.ndarray, factor: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts and scores of the k best that reach least (1 at least), in no order; equal scores at the end by id."""
        live = (factors > 0) & (self.list_begin[terms + 1] > self.list_begin[terms])
        terms, factors = terms[live], factors[live]
        at, end = self.list_begin[terms].copy(), self.list_begin[terms + 1]
        acc = np.zeros(len(self.order), np.int64)
        ahead = factors * self.list_impact[at] if len(at) else np.zeros(0, np.int64)  # what each list may still add
        level, least = int(ahead.max(initial=0)), max(least, 1)
        while True:
            level = int(level * FALL)
            for j in np.flatnonzero(ahead > level):
                a, b = at[j], end[j]
                stop = a + int(np.searchsorted(self.falling[a:b], -(level // factors[j]), side="left"))  # impacts above level / factor
                acc[self.list_text[a:stop]] += factors[j] * self.list_impact[a:stop]
                at[j] = stop
                ahead[j] = factors[j] * self.list_impact[stop] if stop < b else 0
            rest = int(ahead.sum())
            if len(acc) > k:
                least = max(least, int(np.partition(acc, len(acc) - k)[len(acc) - k]))
            may = np.flatnonzero(acc >= least - rest) if least > rest else None
            if not rest or (may is not None and len(may) <= max(FEW, 2 * k)):
                break
        if rest:
            scores = self.complete(may, factor)
        else:
            may = np.flatnonzero(acc >= least)
            scores = acc[may]
        good = scores >= least
        may, scores = may[good], scores[good]
        if len(may) > k:
            best = np.lexsort((self.order[may], -scores))[:k]
            may, scores = may[best], scores[best]
        return may, scores


def best_rows(rows: DataFrame, items: Items, texts: int, length: int, k: int, least: np.ndarray) -> DataFrame:
    """item (its number), doc_id, score: of each task's rows the k best of each item that reach the item's least score."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    known = len(items.number)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        found: dict[int, pa.Table] = {}
        floor = least.copy()
        factor = np.zeros(known, np.int64)

        def search(ids, n, terms, tf) -> None:
            block = Block(ids, n, terms, tf, texts, length, known)
            for i, (own, times) in enumerate(zip(items.terms, items.times, strict=True)):
                factors = items.weights[own] * times
                factor[own] = factors
                may, scores = block.search(own, factors, factor, k, int(floor[i]))
                factor[own] = 0
                if not len(may):
                    continue
                new = pa.table({"doc_id": ids.take(pa.array(may)), "score": pa.array(scores)})
                if i in found:
                    new = pa.concat_tables([found[i], new])
                    if len(new) > k:
                        ranks = pc.sort_indices(new, sort_keys=[("doc_id", "ascending")], null_placement="at_start")
                        new = new.take(ranks)
                        new = new.take(pa.array(np.argsort(-np.asarray(new["score"]), kind="stable")[:k]))
                found[i] = new
                if len(new) >= k:
                    floor[i] = max(floor[i], pc.min(new["score"]).as_py())

        parts, count, size = [], 0, 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                if count and (count + len(part) > BLOCK or size > BLOCK_POSTINGS):
                    search(*_joined(parts))
                    parts, count, size = [], 0, 0
                parts.append(part)
                count += len(part)
                size += sum(len(t) for t in part.column(2).to_pylist()) // 4
        if count:
            search(*_joined(parts))
        for i, table in found.items():
            table = table.combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(table), pa.int32()), table["doc_id"].combine_chunks(), table["score"].combine_chunks()], ["item", "doc_id", "score"])

    def _joined(parts: list):
        import pyarrow as pa

        table = pa.Table.from_batches(parts)
        return table["doc_id"].combine_chunks(), np.asarray(table["n"]), table["terms"].to_pylist(), table["tf"].to_pylist()

    return rows.select("doc_id", "n", "terms", "tf").mapInArrow(run, f"item int, doc_id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_batch(docs: DataFrame, items: Items, k: int, *, id_col: str, text_col: str) -> DataFrame:
    """item, rank, doc_id, score of one batch of items."""
    rows = persist_table(term_frequencies(docs, items, id_col=id_col, text_col=text_col), "frequencies")
    texts, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    items.weights = weights_of(document_frequencies(rows, len(items.number)), texts)
    least = np.zeros(len(items.ids), np.int64)
    parts = texts // FIRST
    if parts > 1:
        first = best_rows(rows.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(parts)) == 0), items, texts, length, k, least)
        for row in _ranked(first, k).filter(F.col("rank") == k).select("item", "score").toLocalIterator():
            least[row.item] = row.score
    return _ranked(best_rows(rows, items, texts, length, k, least), k)


def search(docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best texts of each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    size = asked.agg(F.sum(F.length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    batches = -(-size // BATCH_BYTES) or 1
    kinds = f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score long"
    out = spark.createDataFrame([], kinds)
    for b in range(batches):
        some = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b)
        batch = Items.of([tuple(r) for r in some.toLocalIterator()])
        if not batch.number:
            continue
        ids = spark.createDataFrame(list(enumerate(batch.ids)), f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        found = search_batch(docs, batch, k, id_col=id_col, text_col=text_col).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = out.unionByName(found if batches == 1 else persist_table(found, "ranked"))
    return out
