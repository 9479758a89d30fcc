"""Scalar text functions as columns: quotes, spacing, brackets, HTML, endings, digests, names.

All are plain Catalyst expressions; counters are columns of their own, so that reports are
sums. Character classes are spelled out: Java's short forms know ASCII only.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters, classes and words that decide results.
DOUBLE_QUOTES = "\"“”„‟＂"
REMOVED_QUOTES = "\"“”‘’«»„‟"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]"
# characters below U+0100 one by one, which Java tells by one look at a table, and the others behind one test of their range
SPACE = r"[ \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x{85}\x{A0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]"
CLOSING_PUNCTUATION = r"[,.;:!?%…)\]}»”’]"
OPENING_PUNCTUATION = r"[(\[{«“‘]"
SENTENCE_END = "。！？!?…；;."
CLOSERS = "\"')]}»”’」』】》〉"
PAUSES = ",:;、，"
PROSE = r"[A-Za-zÀ-ỹ0-9\x{4E00}-\x{9FFF}]"
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
LATIN = r"[A-Za-zÀ-ỹ]"
BRACKET_PAIRS = ("()", "[]", "{}", "（）", "【】", "「」", "『』", "《》", "〈〉", "〔〕", "[]", "“”", "‘’", '""', "''")
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_BLOCK_TAG = r"(?i)<\s*/?\s*(?:p|br|div|li|tr|h[1-6]|section|article)\b[^<>]*>"
HTML_TAG = r"</?[a-zA-Z][^<>]{0,200}?>"


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a literal part."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("long")


def char_count(text: Column, chars: str) -> Column:
    """Occurrences of any of some characters."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def any_of(chars: str) -> str:
    """Expression for any of some characters. Spark's translate makes a string of every character that it reads; where none or few match, an expression is faster."""
    near, far = [f"\\x{{{ord(c):X}}}" for c in chars if c < "Ā"], sorted(c for c in chars if c >= "Ā")
    told = "".join(f"\\x{{{ord(c):X}}}" for c in far)
    return "[" + "".join(near) + (f"[\\x{{{ord(far[0]):X}}}-\\x{{{ord(far[-1]):X}}}&&[{told}]]" if far else "") + "]"


def strip(text: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def quotes_to_single(text: Column) -> tuple[Column, Column]:
    """Six kinds of double quotes as an apostrophe; and how many."""
    return F.translate(text, DOUBLE_QUOTES, "'" * len(DOUBLE_QUOTES)), char_count(text, DOUBLE_QUOTES)


def restore_newlines(text: Column) -> tuple[Column, Column]:
    """Literal backslash escapes of line ends as line ends; and how many."""
    has = F.contains(text, F.lit("\\"))
    pattern = r"\\r\\n|\\n|\\r"
    return F.when(has, F.regexp_replace(text, pattern, "\n")).otherwise(text), F.when(has, F.regexp_count(text, F.lit(pattern))).otherwise(0).cast("long")


def normalize_spacing(text: Column) -> Column:
    """One space for runs, none before closing or after opening punctuation or at line ends, one blank line at most."""
    out = text
    for part, by in (("\r\n", "\n"), ("\r", "\n"), ("\u00a0", " ")):
        out = F.replace(out, F.lit(part), F.lit(by))
    for pattern, by in (
        (r"[ \t\x{A0}\x{3000}]{2,}", " "),
        (rf"{SPACE}+({CLOSING_PUNCTUATION})", "$1"),
        (rf"({OPENING_PUNCTUATION}){SPACE}+", "$1"),
        (r"[ \t\x{3000}]+(?=\n|\z)", ""),
        (r"\n{3,}", "\n\n"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return F.btrim(out, F.lit("\n"))


def _lacks_ending(line: Column) -> Column:
    body = strip(line)
    last = F.right(F.regexp_replace(line, rf"{SPACE}+\z", ""), F.lit(1))
    closed = F.contains(F.lit(SENTENCE_END + CLOSERS + PAUSES), last)
    at_once = F.contains(F.lit(SENTENCE_END + CLOSERS + PAUSES), F.right(line, F.lit(1)))  # of most lines, without looking for white space
    return ~at_once & (F.length(body) > 1) & ~closed & line.rlike(PROSE)


def ended_lines(text: Column) -> Column:
    """For each line its text with a period, where it is prose that ends without punctuation; else null."""
    trimmed = lambda x: F.regexp_replace(x, rf"{SPACE}+\z", "")
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(_lacks_ending(x), F.concat(trimmed(x), F.lit("."))))


def with_ended(text: Column, ended: Column) -> Column:
    """text with its ended_lines put in."""
    return F.array_join(F.zip_with(F.split(text, "\n", -1), ended, lambda x, e: F.coalesce(e, x)), "\n")


def ended_count(ended: Column) -> Column:
    return F.size(F.filter(ended, lambda x: x.isNotNull())).cast("long")


def end_sentences(text: Column) -> tuple[Column, Column]:
    """A period after prose lines that end without punctuation; and how many."""
    ended = ended_lines(text)
    return with_ended(text, ended), ended_count(ended)


def bracket_pairs(pairs: Sequence[str]) -> list[str]:
    """The pairs of two characters, white space around them aside; others are passed over."""
    return [q for p in pairs if len(q := p if len(p) == 2 else (p or "").strip()) == 2]


def pair_pattern(pair: str) -> str:
    """Innermost balanced brackets of a kind, their content as group 1."""
    a, b = (re.escape(c) if c in "()[]{}" else c for c in pair)
    return f"{a}([^{a}{b}]*){b}"


def has_escaped_newlines(text: Column) -> Column:
    """Whether a literal escape of a line end occurs."""
    return F.contains(text, F.lit("\\")) & text.rlike(r"\\r|\\n")


def strip_pairs(text: Column, pairs: Sequence[str] = BRACKET_PAIRS, mode: str = "strip") -> Column:
    """Bracket pairs, in the order given: keep, strip (innermost balanced ones, once a pair), or remove every bracket."""
    if mode == "keep":
        return text
    if mode == "remove":
        return F.translate(text, "".join(dict.fromkeys("".join(pairs))), "")
    return reduce(lambda t, p: F.regexp_replace(t, pair_pattern(p), "$1"), bracket_pairs(pairs), text)


def remove_quotes(text: Column, chars: str = REMOVED_QUOTES) -> tuple[Column, Column]:
    """Text without quote characters; and how many there were."""
    return F.translate(text, chars, ""), char_count(text, chars)


def say_symbols(text: Column, words: Mapping[str, str]) -> Column:
    """Symbols replaced by words, longer symbols first, one after the other."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), sorted(words.items(), key=lambda kv: -len(kv[0])), text)


def remove_invisible(text: Column) -> tuple[Column, Column, Column]:
    """Text without control and zero-width characters; and how many of each."""
    return F.regexp_replace(F.regexp_replace(text, CONTROL, ""), ZERO_WIDTH, ""), F.regexp_count(text, F.lit(CONTROL)).cast("long"), F.regexp_count(text, F.lit(ZERO_WIDTH)).cast("long")


def strip_html(text: Column) -> Column:
    """Comments and tags removed, block tags as line ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, HTML_COMMENT, ""), HTML_BLOCK_TAG, "\n"), HTML_TAG, "")


def unescape_basic(text: Column) -> Column:
    """The five entities that need no table, in the order that keeps double escapes."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def language_of(text: Column) -> Column:
    """Script-based language: zh, mixed, vi or unknown."""
    han, latin = F.regexp_count(text, F.lit(HAN)), F.regexp_count(text, F.lit(LATIN))
    return F.when(han > latin * 0.5, "zh").when((han > 0) & (latin > 0), "mixed").when(latin > 0, "vi").otherwise("unknown")


def meaningful(text: Column) -> Column:
    """Whether a letter or a number occurs."""
    return text.rlike(r"[\p{L}\p{N}]")


def slug(text: Column, default: str = "untitled", longest: int = 120) -> Column:
    """A name that is safe for files."""
    out = F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1F]', "_")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\n\r]+", "_"), "_+", "_")
    out = F.left(F.btrim(out, F.lit("._ ")), F.lit(longest))
    return F.when(F.length(out) > 0, out).otherwise(default)


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits count by value (up to 20 digits) and case doesn't."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]") & (F.length(p) < 20), F.lpad(p, 20, "0")).otherwise(p)), "")


def sha256(text: Column) -> Column:
    """Hex SHA-256 of a text."""
    return F.sha2(text, 256)
