"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-cased words joined by single spaces. An item of m
characters may occur with up to k = floor(rate * m) edits. Cut into k + 1 pieces, at
least one piece of it must then occur exactly; so pieces are looked up in every whole
text by one automaton, and the surroundings of each hit are verified by Myers'
bit-parallel edit distance of the item against any substring.

The items are a query set: they are dealt into blocks of bounded size by a hash of the
id, and each block is sent to all tasks and run against all texts. No text is shuffled
and no pair is formed that shares no piece.

Defined results: one row per (document, item) that matches, whatever the number of
places; of several, the least distance and its first end. Items without a word, null
items and null or empty texts match nothing. Items with k = 0 must occur as whole
words. Repeated rows give repeated results; empty tables empty ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import in_batches

#: Bounds of one block of items: characters sent to each task.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    """Lower-cased words joined by single spaces."""
    return " ".join(re.findall(r"\w+", text.lower())) if text else ""


def budget(length: int, rate: float) -> int:
    """Edits allowed in an item of so many characters."""
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of the errors + 1 pieces that cover an item, of nearly equal length."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Edit distance of a pattern to the substrings of a text, a bit per pattern position."""

    def __init__(self, pattern: str) -> None:
        self.size, self.masks = len(pattern), {}
        for i, ch in enumerate(pattern):
            self.masks[ch] = self.masks.get(ch, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(least distance, first end where it is reached); substrings may begin anywhere."""
        full, top = (1 << self.size) - 1, 1 << self.size - 1
        plus, minus, at, least, end = full, 0, self.size, self.size, 0
        masks = self.masks
        for j, ch in enumerate(text, 1):
            equal = masks.get(ch, 0)
            vertical = equal | minus
            horizontal = ((equal & plus) + plus ^ plus) | equal
            up = minus | ~(horizontal | plus) & full
            down = plus & horizontal
            if up & top:
                at += 1
            elif down & top:
                at -= 1
                if at < least:
                    least, end = at, j
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | ~(vertical | up) & full, up & vertical
        return least, end


class PieceIndex:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items, self.errors, self.myers = {}, {}, {}
        places: dict[str, list[tuple[int, int]]] = {}
        for key, item in enumerate(items):
            text = item[1]
            if not text:
                continue
            self.items[key], self.errors[key] = item, budget(len(text), rate)
            if self.errors[key] == 0:
                places.setdefault(f" {text} ", []).append((key, -1))
            else:
                for offset, piece in pieces(text, self.errors[key]):
                    places.setdefault(piece, []).append((key, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, budget, end) of the items that occur in a text within their budgets."""
        words = normal(text)
        if self.empty or not words:
            return []
        padded = f" {words} "
        begins: dict[int, set[int]] = {}
        for end, (size, at) in self.automaton.iter(padded):
            for key, offset in at:
                begins.setdefault(key, set()).add(end - size - offset)  # where the item would begin in words
        out = []
        for key, found in begins.items():
            item_id, item = self.items[key]
            k, size = self.errors[key], len(item)
            if k == 0:
                out.append((item_id, 0, 0, min(found) + size))
                continue
            best, end, windows = k + 1, 0, []
            for begin in sorted(found):  # surroundings that overlap are one
                a, b = max(0, begin - k), min(len(words), begin + size + k)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(b, windows[-1][1])
                else:
                    windows.append([a, b])
            myers = self.myers.get(key)
            if myers is None:
                myers = self.myers[key] = Myers(item)
            for a, b in windows:
                distance, at = myers.best(words[a:b])
                if distance < best:
                    best, end = distance, a + at
                    if best == 0:
                        break
            if best <= k:
                out.append((item_id, best, k, end))
        return out


def find_items(docs: DataFrame, items: DataFrame, *, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, budget, end_char: items that occur in each whole text.

    end_char: end of the occurrence in the normalised text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    queries = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item")).dropna()
    size = queries.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * size / BLOCK_CHARS))
    kind = rows.schema["doc_id"].dataType.simpleString()
    item_kind = "string" if queries.schema["item_id"].dataType.simpleString() == "string" else "long"
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, budget int, end_char int"
    found = None
    for block in range(blocks):
        picked = queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        own = sorted((r["item_id"], normal(r["item"])) for r in picked.collect())  # about BLOCK_CHARS / 2 characters
        part = in_batches(rows).mapInArrow(_searcher(own, rate), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _searcher(items: list[tuple], rate: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = PieceIndex(items, rate)
        for batch in batches:
            found = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in index.search(t.as_py())]
            columns = [*zip(*found, strict=True)] or [()] * 5
            item_kind = pa.int64() if all(isinstance(i, int) for i in columns[1]) else pa.string()
            kinds = (batch.schema.field(0).type, item_kind, pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "budget", "end_char"])

    return run
