"""Token counts by compiled finite-state transducers.

Two deterministic transducers give the number of tokens of a byte-level BPE
vocabulary without running its merges over the text.

*Splitter.* The pattern that cuts text into pieces before the merges is compiled
by hand into a transducer over twelve character classes; a transition says whether
a cut lies before the character read, or before the one ahead of it (one character
of lookahead). A batch of texts is one array of classes. It is dealt into equal
chunks; each chunk yields its state map (entry state -> exit state), the maps are
composed by a parallel prefix scan, and with every chunk's entry state known all
chunks run at once and emit their cuts.

*Counter.* Within a piece, the last token of the encoding of each prefix is the one
vocabulary token that ends there and is compatible with the last token before it
(encoding their joined bytes gives the two back). So a state is the list of starts
from which a token can still be completed, each with the token that ended there and
a count relative to now; a transition on a byte is annotated with the change of the
number of emitted tokens. States are compiled when first met and kept; whole pieces
are kept too, in a table of bounded size.

Nothing is shuffled: each text is counted in the task that reads it.

Defined results: null text counts as empty (0 bytes, 0 tokens); an empty table gives
an empty result; repeated rows give repeated rows; only the two named columns are
read, so further columns of any name don't matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import in_batches

# ---------------------------------------------------------------- splitter

_L, _K, _E, _R, _V, _LL, _N, _SP, _WS, _AP, _O, _END = range(12)
_START, _IN_L, _IN_N, _IN_O, _AFTER_AP, _AP_R, _AP_V, _AP_L, _DONE, _SP1, _WS1, _SP2, _WS2 = range(13)
_STATES = 13
_CUT, _CUT_PREVIOUS = 1, 2
_LETTERS = (_L, _K, _E, _R, _V, _LL)
CHUNK = 64


def _from_boundary(c: int) -> int:
    """State after a character of class c that begins a piece."""
    if c in _LETTERS:
        return _IN_L
    return {_N: _IN_N, _SP: _SP1, _WS: _WS1, _AP: _AFTER_AP, _O: _IN_O, _END: _START}[c]


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission), each indexed by class * states + state."""
    step = np.zeros((12, _STATES), np.uint8)
    emit = np.zeros((12, _STATES), np.uint8)

    def rule(state: int, c: int, to: int, cuts: int) -> None:
        step[c, state], emit[c, state] = to, cuts

    for c in range(12):
        letter, space = c in _LETTERS, c in (_SP, _WS)
        begin = _from_boundary(c)
        for state in (_START, _DONE):
            rule(state, c, begin, _CUT)
        rule(_IN_L, c, *((_IN_L, 0) if letter else (begin, _CUT)))
        rule(_IN_N, c, *((_IN_N, 0) if c == _N else (begin, _CUT)))
        rule(_IN_O, c, *((_IN_O, 0) if c in (_O, _AP) else (begin, _CUT)))
        rule(_AFTER_AP, c, *((_IN_O, 0) if c in (_O, _AP) else (begin, _CUT)))
        for state in (_AP_R, _AP_V, _AP_L):  # "'r" and so on: a contraction or, a character late, a cut after the apostrophe
            rule(state, c, *((_IN_L, _CUT_PREVIOUS) if letter else (begin, _CUT | _CUT_PREVIOUS)))
        joined = _IN_O if c in (_O, _AP) else begin
        rule(_WS1, c, *((_SP2 if c == _SP else _WS2, 0) if space else (begin, _CUT)))
        rule(_SP1, c, *((_SP2 if c == _SP else _WS2, 0) if space else (begin, _CUT) if c == _END else (joined, 0)))
        rule(_SP2, c, *((_SP2 if c == _SP else _WS2, 0) if space else (begin, _CUT) if c == _END else (joined, _CUT_PREVIOUS)))
        rule(_WS2, c, *((_SP2 if c == _SP else _WS2, 0) if space else (begin, _CUT) if c == _END else (begin, _CUT | _CUT_PREVIOUS)))
    rule(_AFTER_AP, _K, _DONE, 0)
    rule(_AFTER_AP, _R, _AP_R, 0)
    rule(_AFTER_AP, _V, _AP_V, 0)
    rule(_AFTER_AP, _LL, _AP_L, 0)
    rule(_AP_R, _E, _DONE, 0)
    rule(_AP_V, _E, _DONE, 0)
    rule(_AP_L, _LL, _DONE, 0)
    return step.ravel(), emit.ravel()


class CharacterClasses:
    """Class of each code point, asked of the tokenizers library (whose Unicode tables decide) when first met."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, 255, np.uint8)
        for chars, kind in (("stmd", _K), ("e", _E), ("r", _R), ("v", _V), ("l", _LL), (" ", _SP), ("'", _AP)):
            for ch in chars:
                self.table[ord(ch)] = kind
        self.learn(np.arange(0x250))

    def learn(self, codes: np.ndarray) -> None:
        from tokenizers import Regex, pre_tokenizers

        codes = codes[self.table[codes] == 255]
        self.table[codes] = _O
        text = "".join(map(chr, codes.tolist()))
        for pattern, kind in ((r"\p{L}+", _L), (r"\p{N}+", _N), (r"\s+", _WS)):
            for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text) if text else ():
                self.table[codes[a:b]] = kind

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = self.table[codes]
        if (new := out == 255).any():
            self.learn(np.unique(codes[new]))
            out = self.table[codes]
        return out


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), in log2(rows) rounds."""
    maps, width = maps.copy(), 1
    while width < len(maps):
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width], axis=1)
        width *= 2
    return maps


def find_cuts(classes: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """True where a piece begins. The first character is read in the start state."""
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, _END, np.uint16)
    grid[:n] = classes
    grid = np.ascontiguousarray((grid * _STATES).reshape(rows, CHUNK).T)
    maps = np.broadcast_to(np.arange(_STATES, dtype=np.uint8), (rows, _STATES))
    for j in range(CHUNK):
        maps = step.take(grid[j][:, None] + maps)
        if j % 4 == 3 and (maps == maps[:, :1]).all():  # every entry state has led to the same state
            last = maps[:, 0]
            for column in grid[j + 1 :]:
                last = step.take(column + last)
            maps = np.repeat(last[:, None], _STATES, axis=1)
            break
    state = np.zeros(rows, np.uint8)
    state[1:] = scan_maps(maps)[:-1, _START]
    cuts = np.empty((CHUNK, rows), np.uint8)
    for j in range(CHUNK):
        at = grid[j] + state
        cuts[j] = emit.take(at)
        state = step.take(at)
    cuts = cuts.T.ravel()[:n]
    begins = (cuts & _CUT).astype(bool)
    begins[:-1] |= (cuts[1:] & _CUT_PREVIOUS).astype(bool)
    return begins


# ---------------------------------------------------------------- counter


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


#: Characters of the longest piece whose count is kept.
LONGEST_KEPT = 64


class CountTransducer:
    """Number of tokens of a piece, by transitions that carry changes of the count."""

    def __init__(self, merges: list[tuple[bytes, bytes]], limit: int = 250_000) -> None:
        self.limit = limit
        number = {bytes([b]): b for b in range(256)}
        #: By token: rank of the merge that makes it (-1: a byte), and its two parts.
        self.rank, self.parts = [-1] * 256, [(b, b) for b in range(256)]
        self.merged: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            self.merged[number[a] << 32 | number[b]] = rank
            if a + b not in number:
                number[a + b] = len(self.rank)
                self.rank.append(rank)
                self.parts.append((number[a], number[b]))
        self.child: dict[int, int] = {}
        self.ends: list[int | None] = [None]
        self.more: list[bool] = [False]
        self.fits: dict[int, bool] = {}
        for token, n in number.items():
            if n >= 256 and not self.compatible(*self.parts[n]) and self.merged[self.parts[n][0] << 32 | self.parts[n][1]] != self.rank[n]:
                continue  # no text gives this token
            node = 0
            for b in token:
                self.more[node] = True
                to = self.child.get(node << 8 | b)
                if to is None:
                    to = self.child[node << 8 | b] = len(self.ends)
                    self.ends.append(None)
                    self.more.append(False)
                node = to
            self.ends[node] = n
        self.forget()

    def forget(self) -> None:
        """Drop compiled states and kept pieces; they are compiled again when met."""
        self.states: list[tuple] = [((0, None, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]
        self.pieces: dict[str, int] = {}

    def compatible(self, a: int | None, b: int) -> bool:
        """Whether encoding the joined bytes of tokens a and b gives the two back.

        Undoes the merges that made the two tokens, the latest first, and looks at each
        stage whether the pair across the boundary would have been merged before the
        merge undone last. Of equal ranks the left one goes first.
        """
        if a is None:
            return True
        known = self.fits.get(a << 32 | b)
        if known is not None:
            return known
        left, right, until, fits = a, b, 1 << 60, True
        while True:
            bridge = self.merged.get(left << 32 | right)
            if bridge is not None and bridge < until:
                fits = False
                break
            if self.rank[left] > self.rank[right]:
                until, left = self.rank[left], self.parts[left][1]
            elif self.rank[right] >= 0:
                until, right = self.rank[right] + 1, self.parts[right][0]
            else:
                break
        if len(self.fits) > self.limit:
            self.fits.clear()
        self.fits[a << 32 | b] = fits
        return fits

    def compile_step(self, state: int, b: int) -> tuple[int, int]:
        starts, last, count = [], None, 0
        for node, token, n in self.states[state]:
            to = self.child.get(node << 8 | b)
            if to is None:
                continue
            if last is None and (end := self.ends[to]) is not None and self.compatible(token, end):
                last, count = end, n + 1
            if self.more[to]:
                starts.append((to, token, n))
        key = (*((node, token, n - count) for node, token, n in starts), (0, last, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        self.steps[state][b] = to, count
        return to, count

    def count(self, piece: str) -> int:
        state = total = 0
        steps = self.steps
        for b in piece.encode():
            move = steps[state].get(b) or self.compile_step(state, b)
            state = move[0]
            total += move[1]
        return total

    def counts(self, pieces: list[str]) -> list[int]:
        if len(self.pieces) > self.limit or len(self.states) > self.limit:
            self.forget()
        kept, count, long = self.pieces, self.count, {}
        for piece in set(pieces).difference(kept):
            (kept if len(piece) <= LONGEST_KEPT else long)[piece] = count(piece)
        return [kept[p] if p in kept else long[p] for p in pieces] if long else [kept[p] for p in pieces]


class TokenCounter:
    """Counts for batches of texts, from a vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {s: b for b, s in byte_symbols().items()}
        raw = lambda s: bytes(back[c] for c in s)
        merges = [(raw(a), raw(b)) for a, b in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.counter = CountTransducer(merges)
        self.step, self.emit = compile_splitter()
        self.classes = CharacterClasses()

    def segments(self, text: str) -> list[str]:
        """The text between special strings, which are a token each."""
        parts = [text]
        for s in self.special:
            if s in text:
                parts = [x for p in parts for x in p.split(s)]
        return parts

    def __call__(self, texts: list[str]) -> np.ndarray:
        segments, extra = [], np.zeros(len(texts), np.int64)
        sizes = np.ones(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = self.segments(text)
            segments += parts
            sizes[i], extra[i] = len(parts), len(parts) - 1
        joined = "\n".join(segments) + "\n" if segments else ""
        if not joined:
            return extra
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.classes(code)
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) + 1) - 1
        classes[ends] = _END
        begins = np.flatnonzero(find_cuts(classes, self.step, self.emit))
        is_end = np.zeros(len(code), bool)
        is_end[ends] = True
        edges = begins.tolist()
        pieces = [joined[a:b] for a, b in zip(edges, [*edges[1:], len(joined)], strict=True)]
        n = np.fromiter(self.counter.counts(pieces), np.int64, len(pieces))
        n[is_end[begins]] = 0
        total = np.concatenate(([0], np.cumsum(n)))
        upto = total[np.searchsorted(begins, ends)]  # pieces before each segment's end
        upto = upto[np.cumsum(sizes) - 1]
        return np.diff(upto, prepend=0) + extra


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row's whole text.

    vocabulary: path of a byte-level BPE file, readable on every executor.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = None
        for batch in batches:
            counter = counter or TokenCounter(vocabulary)
            ids, texts = batch.column(0), batch.column(1)
            size = np.asarray(pc.binary_length(texts), np.int64) if len(ids) else np.zeros(0, np.int64)
            out, begin = np.zeros(len(ids), np.int64), 0
            edge = np.cumsum(size)
            while begin < len(ids):  # about 4 MB of text at once
                end = max(begin + 1, int(np.searchsorted(edge, (edge[begin - 1] if begin else 0) + 4_000_000)))
                out[begin:end] = counter(texts.slice(begin, end - begin).to_pylist())
                begin = end
            yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(out)], ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = in_batches(rows).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
