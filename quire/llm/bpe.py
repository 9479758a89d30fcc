"""BPE encoding and decoding with forced boundaries.

A pair of adjacent byte symbols that occurs inside no vocabulary token can never be
bridged by a merge, so there is a certain cut between the two. Each word is split at
these cuts; the fragments are encoded independently of each other, by merges in order
of rank, and their ids concatenated. The fragments of all new words of a group of texts
are merged side by side, one merge each at a time, as rows of a matrix. Words are kept in
a table of bounded size. No shuffle: each text is encoded in the task that reads it.

Defined results: null text counts as empty and gives no ids and an empty decoded text;
an empty table gives an empty result; repeated rows give repeated rows. Special strings
inside a text become their special ids. Ids that the vocabulary lacks decode to nothing.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.token_counts import byte_symbols
from quire.session import in_batches


#: Characters of the longest word or fragment that is kept in a table; bytes of the longest fragment that is merged beside others.
LONGEST_KEPT = 64
#: Characters of texts whose new words are encoded together; cells of the matrix of fragments that are merged side by side.
GROUP, CELLS = 1 << 19, 1 << 17
#: New words that are encoded one by one; words of a longer text that are looked up at a time.
FEW, MANY = 400, 1 << 17
#: Rank of what doesn't merge.
NONE = (1 << 31) - 1


class _Words(dict):
    """What ask tells of words, in two generations: where the newer holds limit words it takes the place of the older, of which words that are met again go on."""

    def __init__(self, ask: Callable[[str], tuple[bytes, str]], ask_all: Callable[[list[str]], Iterable[tuple[bytes, str]]], limit: int) -> None:
        self.ask, self.ask_all, self.limit, self.older = ask, ask_all, limit, {}

    def learn(self, words: set[str]) -> None:
        """The newer generation has all the words afterwards but for those longer than LONGEST_KEPT, which are asked for each time."""
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        unknown, older = words.difference(self), self.older
        new = [word for word in unknown if word not in older and len(word) <= LONGEST_KEPT]
        self.update((word, older[word]) for word in unknown if word in older)
        self.update(zip(new, map(self.ask, new) if len(new) < FEW else self.ask_all(new)))

    def __missing__(self, word: str) -> tuple[bytes, str]:
        return self.ask(word)


class ForcedBoundaryBPE:
    """Encoder and decoder for a word-level BPE file whose words end in a suffix."""

    def __init__(self, path: str, limit: int = 60_000) -> None:
        import numpy as np
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.limit, self.suffix = limit, model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        symbols, self.lacking = [c for _, c in sorted(byte_symbols().items())], max(self.token, default=-1) + 1
        number = dict(model["vocab"])  # of tokens and symbols; those that the vocabulary lacks count from self.lacking on
        known = lambda t: number.setdefault(t, self.lacking + len(number))
        self.first, self.last = [known(c) for c in symbols], [known(c + self.suffix) for c in symbols]
        #: Pairs of numbers that merge, by rank and number of what they make, in one number.
        self.merges: dict[int, int] = {}
        for rank, (x, y) in enumerate(model["merges"]):
            self.merges[known(x) << 32 | known(y)] = rank << 32 | known(x + y)
        #: The same as sorted pairs (base times the first and the second, and one above all), ranks, and what a rank makes.
        self.base = max(number.values()) + 2
        pairs = sorted(((pair >> 32) * self.base + (pair & 0xFFFFFFFF), made >> 32) for pair, made in self.merges.items())
        self.pairs = np.array([*(x for x, _ in pairs), 1 << 62], "i8")
        self.ranks = np.array([*(rank for _, rank in pairs), NONE], "i4")
        self.made = np.zeros(len(model["merges"]), "i4")
        for made in self.merges.values():
            self.made[made >> 32] = made & 0xFFFFFFFF
        self.symbols = np.array(self.first + self.last, "i4")
        #: Pairs of bytes that occur inside a token; between all others is a forced boundary.
        byte = {c: i for i, c in enumerate(symbols)}
        self.inside = bytearray(1 << 16)
        for t in self.vocab:
            for x, y in pairwise(t.removesuffix(self.suffix) if self.suffix else t):
                if x in byte and y in byte:
                    self.inside[byte[x] << 8 | byte[y]] = 1
        bare = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "decoder": None}
        self.normalizer = Tokenizer.from_str(json.dumps(spec | bare)).normalizer
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        plain = split["pattern"]["Regex"].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
        self.plain_words = self.words if r"\p" in plain.lower() else re.compile(plain, re.ASCII).findall
        self.usual, self.unusual = set(), set()
        self.even, self.uneven = set(), set()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.fragments: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.kept = _Words(self.told, self.told_all, limit)

    def merge(self, parts: list[int]) -> list[int]:
        """Ids after all merges within one fragment, the lowest rank first and of equals the leftmost."""
        made, none, low = self.merges.get, 1 << 62, (1 << 32) - 1
        while len(parts) > 256:  # long fragments: all places of a pair in one pass
            best = min(made(x << 32 | y, none) for x, y in pairwise(parts))
            if best == none:
                break
            out, i = [], 0
            while i < len(parts):
                hit = i + 1 < len(parts) and made(parts[i] << 32 | parts[i + 1], none) == best
                out.append(best & low if hit else parts[i])
                i += 2 if hit else 1
            parts = out
        order = [made(x << 32 | y, none) for x, y in pairwise(parts)]
        while order and (best := min(order)) < none:
            i = order.index(best)
            parts[i] = new = best & low
            del parts[i + 1], order[i]
            if i:
                order[i - 1] = made(parts[i - 1] << 32 | new, none)
            if i < len(order):
                order[i] = made(new << 32 | parts[i + 1], none)
        return parts if max(parts, default=0) < self.lacking else [x for x in parts if x < self.lacking]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the normalised text."""
        data, inside = word.encode(), self.inside
        parts = [*map(self.first.__getitem__, data[:-1]), self.last[data[-1]]]
        cuts = [i for i, (x, y) in enumerate(pairwise(data), 1) if not inside[x << 8 | y]]
        if not cuts:
            return self.merge(parts)
        ids: list[int] = []
        for a, b in pairwise((0, *cuts, len(parts))):
            fragment = tuple(parts[a:b])
            got = self.fragments.get(fragment)
            if got is None:
                got = tuple(self.merge(list(fragment)))
                if len(fragment) <= LONGEST_KEPT:
                    if len(self.fragments) > self.limit:
                        self.fragments.clear()
                    self.fragments[fragment] = got
            ids += got
        return ids

    def told(self, word: str) -> tuple[bytes, str]:
        """Ids of a word as little-endian 32 bits, and what they decode to."""
        ids = self.encode_word(word)
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def ranked(self, x, y):
        """Rank of the merge of each pair of numbers, NONE where there is none."""
        import numpy as np

        pairs = x.astype("i8") * self.base + y
        at = self.pairs.searchsorted(pairs)
        return np.where(self.pairs[at] == pairs, self.ranks[at], NONE)

    def merge_rows(self, rows):
        """Fragments of equal or smaller width, filled up with base - 1, after all merges; -1 after the last number of each.

        As merge(): the lowest rank first and of equals the leftmost. Every row that goes on gets one number narrower at
        each step; the first and last columns stand for the fragments' ends.
        """
        import numpy as np

        end = self.base - 1
        out = np.full(rows.shape, -1, "i4")
        at, rows = np.arange(len(rows)), np.pad(rows, ((0, 0), (1, 1)), constant_values=end)
        order = self.ranked(rows[:, :-1], rows[:, 1:])
        while len(at):
            i = order.argmin(1)
            best = order[np.arange(len(at)), i]
            if (done := best == NONE).any():
                got = rows[done, 1:-1]
                out[at[done], : got.shape[1]] = np.where(got == end, -1, got)
                go = ~done
                at, rows, order, i, best = at[go], rows[go], order[go], i[go], best[go]
            own = np.arange(len(at))
            rows[own, i] = self.made[best]
            columns = np.arange(rows.shape[1] - 1)
            rows = np.where(columns > i[:, None], rows[:, 1:], rows[:, :-1])
            order = np.where(columns[:-1] >= i[:, None], order[:, 1:], order[:, :-1])
            order[own, i - 1] = self.ranked(rows[own, i - 1], rows[own, i])
            order[own, i] = self.ranked(rows[own, i], rows[own, i + 1])
        return out

    def told_all(self, words: list[str]) -> Iterator[tuple[bytes, str]]:
        """As told(), of many words: their fragments are merged side by side."""
        import numpy as np

        coded = [w.encode() for w in words]
        data = np.frombuffer(b"".join(coded), "u1")
        ends = np.cumsum(np.fromiter(map(len, coded), "i8", len(coded)))
        numbers = data.astype("i4")
        numbers[ends - 1] += 256
        numbers = self.symbols[numbers]
        cut = np.zeros(len(data), bool)  # after a byte
        cut[ends - 1] = True
        cut[:-1] |= np.frombuffer(self.inside, "u1")[data[:-1].astype("i4") << 8 | data[1:]] == 0
        stops = np.flatnonzero(cut) + 1
        starts = np.concatenate(([0], stops[:-1])).astype("i8")
        width = stops - starts
        for a, b in zip(starts[width > LONGEST_KEPT].tolist(), stops[width > LONGEST_KEPT].tolist()):
            got = self.merge(numbers[a:b].tolist())
            numbers[a:b] = -1
            numbers[a : a + len(got)] = got
        short = np.flatnonzero((width > 1) & (width <= LONGEST_KEPT))
        short = short[width[short].argsort(kind="stable")]
        while len(short):
            least = int(width[short[0]])
            most = min(least + least // 4, LONGEST_KEPT)
            taken, short = np.split(short, [min(max(1, CELLS // most), int(width[short].searchsorted(most, "right")))])
            own = np.arange(most) < width[taken][:, None]
            cells = starts[taken][:, None] + np.arange(most)
            rows = np.where(own, numbers[np.minimum(cells, len(numbers) - 1)], self.base - 1)
            numbers[cells[own]] = self.merge_rows(rows)[own]
        stay = (numbers >= 0) & (numbers < self.lacking)
        ids = numbers[stay].astype("<u4")
        upto = [0, *np.cumsum(stay)[ends - 1].tolist()]
        raw, tokens = ids.tobytes(), list(map(self.token.__getitem__, ids.tolist()))
        for a, b in pairwise(upto):
            yield raw[4 * a : 4 * b], " ".join(tokens[a:b])

    def split(self, text: str) -> list[str]:
        """Words of a normalised text. Where the library's Unicode tables and regex's class a character differently, the library splits."""
        find = self.plain_words if text.isascii() else self.words
        if not self.usual.issuperset(text):
            for ch in set(text) - self.usual - self.unusual:
                told = [w for w, _ in self.splitter.pre_tokenize_str(f"a{ch}1{ch}!{ch}")]
                same = self.words(f"a{ch}1{ch}!{ch}") == told and (not ch.isascii() or self.plain_words(f"a{ch}1{ch}!{ch}") == told)
                (self.usual if same else self.unusual).add(ch)
            if not self.unusual.isdisjoint(text):
                return [w for w, _ in self.splitter.pre_tokenize_str(text)]
        return find(text)

    def normal(self, text: str) -> str:
        """The normalised text. White space of any kind parts words and goes, so that in composed texts only case matters."""
        if text.isascii():
            return text.lower()
        if not self.even.issuperset(text):
            for ch in set(text) - self.even - self.uneven:
                made = self.normalizer.normalize_str(ch)
                same = ch != "Σ" and unicodedata.category(ch) != "Cn" and (made == ch.lower() or made == " " and not self.words(ch))
                (self.even if same else self.uneven).add(ch)
        if self.uneven.isdisjoint(text) and unicodedata.is_normalized("NFC", text):
            return text.lower()
        return self.normalizer.normalize_str(text)

    def cut(self, text: str) -> list[str | list[str]]:
        """Special strings of a text, and lists of the words between them."""
        parts = self.split_special(text) if "<|" in text else (text,)
        return [part if part in self.special else self.split(self.normal(part)) for part in parts]

    def joined(self, group: list[list[str | list[str]]]) -> Iterator[tuple[bytes, str]]:
        if len(group) > 1:
            self.kept.learn(set(chain.from_iterable(words for parts in group for words in parts if not isinstance(words, str))))
        for parts in group:
            ids, decoded = [], []
            for part in parts:
                if isinstance(part, str):
                    ids.append(self.special[part].to_bytes(4, "little"))
                    decoded.append(part)
                    continue
                for k in range(0, len(part), MANY):
                    words = part[k : k + MANY]
                    if len(group) == 1:
                        self.kept.learn(set(words))
                    got = list(map(self.kept.__getitem__, words))
                    ids += [own for own, _ in got]
                    decoded += [read for own, read in got if own]
            yield b"".join(ids), " ".join(decoded)

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[bytes, str]]:
        """Of each text the ids as little-endian 32 bits, and what they decode to. The words of GROUP characters, or of a longer text, are met at once."""
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > GROUP:
                yield from self.joined(group)
                group, size = [], 0
            group.append(self.cut(text))
            size += len(text)
        if group:
            yield from self.joined(group)

    def encode_bytes(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32 bits, and what they decode to."""
        return next(self.encode_all([text]))

    def encode(self, text: str) -> list[int]:
        data = self.encode_bytes(text)[0]
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, the tokens joined by spaces."""
        return " ".join(self.token[i] for i in ids if i in self.token)


def _batches(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, schema: str, make) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = None  # its tables go with the task: workers that are used again would hold them beside what comes next
        for batch in batches:
            bpe = bpe or ForcedBoundaryBPE(vocabulary)
            columns = make(bpe, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns.values()], ["doc_id", *columns])

    return in_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def encode_texts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string: the encoding of each whole text and its decoding."""

    def make(bpe: ForcedBoundaryBPE, texts) -> dict:
        import numpy as np
        import pyarrow as pa

        got = list(bpe.encode_all(t.as_py() for t in texts))
        ids = [np.frombuffer(a, "<u4").astype("i4") for a, _ in got]
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([b for _, b in got], pa.string())}

    return _batches(docs, id_col, text_col, vocabulary, "ids array<int>, decoded string", make)


def encode_digests(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as encode_texts(), without sending ids on."""

    def make(bpe: ForcedBoundaryBPE, texts) -> dict:
        from hashlib import sha256

        import pyarrow as pa

        n, ids, decoded = [], [], []
        for a, b in bpe.encode_all(t.as_py() for t in texts):
            n.append(len(a) // 4)
            ids.append(sha256(a).hexdigest())
            decoded.append(sha256(b.encode()).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    return _batches(docs, id_col, text_col, vocabulary, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def decode_ids(rows: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: the text of each row's ids; null ids count as none."""
    picked = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = None
        for batch in batches:
            bpe = bpe or ForcedBoundaryBPE(vocabulary)
            out = [bpe.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return in_batches(picked).mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, decoded string")
