"""Regular expressions of users, in Python's dialect.

They are compiled and run by Python's own engine, in Arrow batches; nothing is translated. A
literal that every match must have is taken from the parsed expression and looked for by the JVM
first, so that other rows never leave it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from re import _constants as K
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def problem(pattern: str, replacement: str | None = None) -> str | None:
    """Why an expression, or a replacement for it, can't be used; None if it can."""
    try:
        compiled = re.compile(pattern)
        if replacement is not None:
            compiled.sub(replacement, "")
    except (re.error, OverflowError, RecursionError) as error:
        return str(error) or type(error).__name__
    return None


def needed_literal(pattern: str) -> str:
    """The longest run of characters that stands in every match of a well-formed expression; empty if none can be told.

    Runs are read along the sequence of an expression, into groups and what is repeated at least
    once; alternatives, classes, look-arounds and parts where case doesn't matter end a run.
    """
    parsed = parser.parse(pattern)
    if parsed.state.flags & (re.IGNORECASE | re.LOCALE):
        return ""
    runs, now = [""], []

    def close() -> None:
        runs.append("".join(now))
        now.clear()

    def read(sequence) -> None:
        for op, value in sequence:
            if op is K.LITERAL:
                now.append(chr(value))
            elif op is K.SUBPATTERN:
                _, on, _, inner = value
                if on & re.IGNORECASE:
                    close()
                else:
                    read(inner)
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
                least, most, inner = value
                close()
                if least:
                    read(inner)
                    close()
            elif op is K.ATOMIC_GROUP:
                read(value)
            elif op is not K.AT:
                close()

    read(parsed)
    close()
    return max(runs, key=len)


def _screened(text: Column, patterns: Sequence[str]) -> Column:
    """Text where one of the expressions may match, null elsewhere."""
    literals = [needed_literal(p) for p in patterns]
    if not all(literals):
        return text
    has = F.lit(False)
    for literal in dict.fromkeys(literals):
        has = has | F.contains(text, F.lit(literal))
    return F.when(has, text)


@lru_cache(maxsize=256)
def _grouper(pattern: str, names: tuple[str, ...]):
    @F.arrow_udf(", ".join(f"{n} string" for n in names).join(("struct<", ">")).replace(" string", ":string"))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled = re.compile(pattern)
        for lines in batches:
            found = [None if (text := line.as_py()) is None or (m := compiled.match(text)) is None else {n: m[n] for n in names} for line in lines]
            yield pa.array(found, pa.struct([(n, pa.string()) for n in names]))

    return run


def groups(text: Column, pattern: str, names: Sequence[str]) -> Column:
    """Struct of named groups of a match at a text's beginning, as Python's match finds it; null without one."""
    known = tuple(n for n in names if n in re.compile(pattern).groupindex)
    found = _grouper(pattern, known)(_screened(text, [pattern]))
    return F.when(found.isNotNull(), F.struct(*(found[n].alias(n) if n in known else F.lit(None).cast("string").alias(n) for n in names)))


@lru_cache(maxsize=256)
def _replacer(rules: tuple[tuple[str, str], ...]):
    @F.arrow_udf("struct<text:string,n:bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled = [(re.compile(pattern), replacement) for pattern, replacement in rules]
        for texts in batches:
            out, hits = [], []
            for text in texts:
                text, n = text.as_py(), 0
                if text is not None:
                    for pattern, replacement in compiled:
                        text, k = pattern.subn(replacement, text)
                        n += k
                out.append(text)
                hits.append(n)
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(hits, pa.int64())], ["text", "n"])

    return run


def replaced(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct of text and n: rules (expression, replacement) one after the other, as Python's subn makes them, and the matches replaced; text null where none can match."""
    return _replacer(tuple(rules))(_screened(text, [p for p, _ in rules]) if len(rules) == 1 else text)
