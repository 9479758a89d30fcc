"""Cleaning and sanitizing of texts, with a counter for every step.

Cleaning is a chain of projections: each step is one expression on the column that the step
before made, so the work is done once and stays in the JVM; only entities go through Arrow, for
rows with an ampersand. Sanitizing needs spans of a text that its steps pass by, a stack of marks
and composition, which no built-in expression has: it is one pass over each text in Python, in
Arrow batches of bounded size, in the task that reads it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import boundaries as B
from quire.functions import expressions as X
from quire.functions.text import BRACKET_PAIRS, CONTROL, HTML_BLOCK_TAG, HTML_COMMENT, HTML_TAG, REMOVED_QUOTES, ZERO_WIDTH, any_of, bracket_pairs, char_count, count_of, ended_count, ended_lines, normalize_spacing, pair_pattern, with_ended
from quire.session import in_batches

# Words for symbols.
SYMBOL_WORDS = {"&": " và ", "<": " nhỏ hơn ", ">": " lớn hơn ", "%": " phần trăm ", "+": " cộng ", "=": " bằng ", "*": " sao ", "@": " a còng ", "#": " thăng ", "$": " đô la ", "~": " xấp xỉ ", "^": " mũ "}


@dataclass(frozen=True)
class Rule:
    """A user's replacement: a literal, or a regular expression in Python's dialect; \\1 and \\g<name> in the replacement are groups."""

    pattern: str
    replacement: str = ""
    regex: bool = True

    def problem(self) -> str | None:
        """Why the rule can't be used; None if it can."""
        return X.problem(self.pattern, self.replacement) if self.regex else None


def rule_problems(rules: Sequence[Rule]) -> list[tuple[int, str]]:
    """(place, reason) of the rules that clean passes over, to be shown to their author."""
    return [(i, reason) for i, rule in enumerate(rules) if (reason := rule.problem())]


@dataclass(frozen=True)
class CleanOptions:
    """Steps of the cleaning pass; quotes and brackets: keep, strip (of brackets, balanced pairs only) or remove."""

    control: bool = True
    zero_width: bool = True
    html: bool = True
    entities: bool = True
    brackets: str = "strip"
    bracket_pairs: Sequence[str] = BRACKET_PAIRS
    quotes: str = "strip"
    quote_chars: str = ""
    symbols: Mapping[str, str] | None = None
    rules: Sequence[Rule] = ()
    spacing: bool = True
    drop_empty_lines: bool = False
    endings: bool = False

    def for_speech(self) -> CleanOptions:
        """Only the user's own rules: sanitizing does the rest and needs the structure."""
        return CleanOptions(control=False, zero_width=False, html=False, entities=False, brackets="keep", quotes="keep", symbols={}, rules=self.rules, spacing=False)


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(html.unescape, na_action="ignore")


class _Chain:
    """The text column of a table, step by step, and its counters."""

    def __init__(self, rows: DataFrame, text_col: str) -> None:
        self.rows, self.text = in_batches(rows), text_col
        self.counters: list[str] = []
        self.step(F.coalesce(self.col(), F.lit("")))  # what makes the text is run once, not for the first counts and the first step

    def col(self) -> Column:
        return F.col(self.text)

    def counted(self, name: str, count: Column) -> dict[str, Column]:
        if name in self.counters:
            count = F.col(name) + count
        else:
            self.counters.append(name)
        return {name: count.cast("long")}

    def add(self, name: str, count: Column) -> None:
        """Add a count, of the text as it is now, to a counter."""
        self.rows = self.rows.withColumns(self.counted(name, count))

    def step(self, new: Column, name: str = "", count: Column | None = None) -> None:
        """The new text, and a count of the text before it. A generator holds the text, so that the optimizer doesn't write all steps into one expression, in which each is there several times."""
        if name:
            self.add(name, count)
        self.rows = self.rows.withColumn(self.text, F.explode(F.array(new)))

    def shrink(self, new: Column, name: str, by: int = 1) -> None:
        """The new text, and a count of changes of which each takes away so many characters (adds them, if less than 0): told by the lengths, without a search of its own."""
        self.rows = self.rows.withColumn("_was", F.length(self.col()))
        self.step(new)
        self.add(name, F.floor((F.col("_was") - F.length(self.col())) / by))
        self.rows = self.rows.drop("_was")

    def sub(self, pattern: str, by: str, name: str = "", needs: str = "") -> None:
        """Replace a pattern; needs: a literal without which nothing matches, looked for first."""
        text, lit = self.col(), F.lit(pattern)
        has = F.contains(text, F.lit(needs)) if needs else None
        new, count = F.regexp_replace(text, lit, F.lit(by)), F.regexp_count(text, lit)
        if has is not None:
            new, count = F.when(has, new).otherwise(text), F.when(has, count).otherwise(0)
        self.step(new, name, count)


def clean(rows: DataFrame, options: CleanOptions = CleanOptions(), *, text_col: str = "text") -> DataFrame:
    """rows with the text cleaned, and counters: before_chars, after_chars, lost_chars, control_chars, zero_width, html_tags,
    html_entities, bracket_pairs_removed, brackets_removed, quotes_removed, symbols_replaced, custom_rule_hits,
    blank_lines_collapsed, periods_added. Null counts as an empty text. Rules that can't be used are passed over (rule_problems names them). Columns of the counters' names are replaced.
    """
    c = _Chain(rows, text_col)
    every = ("control_chars", "zero_width", "html_tags", "html_entities", "bracket_pairs_removed", "quotes_removed", "symbols_replaced", "custom_rule_hits", "blank_lines_collapsed", "periods_added")
    c.add("before_chars", F.length(c.col()))
    for on, pattern, name in ((options.control, CONTROL, "control_chars"), (options.zero_width, ZERO_WIDTH, "zero_width")):
        if on:
            c.shrink(F.regexp_replace(c.col(), pattern, ""), name)
    if options.html:
        for pattern, by in ((HTML_COMMENT, ""), (HTML_BLOCK_TAG, "\n"), (HTML_TAG, "")):
            c.sub(pattern, by, "html_tags", "<")
    if options.entities:
        entity = r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);"
        has = F.contains(c.col(), F.lit("&"))
        c.rows = c.rows.withColumn("_decoded", F.coalesce(F.replace(_unescape(F.when(has, c.col())), F.lit("\u00a0"), F.lit(" ")), c.col()))
        c.step(F.col("_decoded"), "html_entities", F.when(has & (F.col("_decoded") != c.col()), F.regexp_count(c.col(), F.lit(entity))).otherwise(0))
        c.rows = c.rows.drop("_decoded")
    if options.brackets == "remove":
        chars = "".join(dict.fromkeys("".join(bracket_pairs(options.bracket_pairs))))
        removed = char_count(c.col(), chars)
        c.step(F.translate(c.col(), chars, ""), "brackets_removed", removed)
        c.add("bracket_pairs_removed", F.floor(F.col("brackets_removed") / 2))
    elif options.brackets == "strip":
        for pair in bracket_pairs(options.bracket_pairs):
            c.shrink(F.when(F.contains(c.col(), F.lit(pair[0])), F.regexp_replace(c.col(), pair_pattern(pair), "$1")).otherwise(c.col()), "bracket_pairs_removed", 2)
        c.add("brackets_removed", 2 * F.col("bracket_pairs_removed"))
    else:
        c.add("brackets_removed", F.lit(0))
    if options.quotes != "keep":
        chars = options.quote_chars or REMOVED_QUOTES
        c.shrink(F.regexp_replace(c.col(), any_of(chars), ""), "quotes_removed")
    for symbol, word in sorted((SYMBOL_WORDS if options.symbols is None else options.symbols).items(), key=lambda kv: -len(kv[0])):
        new = F.replace(c.col(), F.lit(symbol), F.lit(word))
        if symbol and len(symbol) != len(word):
            c.shrink(new, "symbols_replaced", len(symbol) - len(word))
        elif symbol:
            c.step(new, "symbols_replaced", count_of(c.col(), symbol))
    for regex, run in groupby((r for r in options.rules if r.pattern and not r.problem()), key=lambda r: r.regex):
        if regex:
            c.rows = c.rows.withColumn("_ruled", X.replaced(c.col(), [(r.pattern, r.replacement) for r in run]))
            c.step(F.coalesce("_ruled.text", c.col()), "custom_rule_hits", F.coalesce("_ruled.n", F.lit(0)))
            c.rows = c.rows.drop("_ruled")
            continue
        for rule in run:
            c.step(F.replace(c.col(), F.lit(rule.pattern), F.lit(rule.replacement)), "custom_rule_hits", count_of(c.col(), rule.pattern))
    if options.spacing:
        blank = "\n\n\n"
        c.rows = c.rows.withColumn("_before", count_of(c.col(), blank))
        c.step(normalize_spacing(c.col()))
        c.add("blank_lines_collapsed", F.greatest(F.col("_before") - count_of(c.col(), blank), F.lit(0)))
        c.rows = c.rows.drop("_before")
    if options.drop_empty_lines:
        lines = F.filter(F.split(c.col(), "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"))
        c.step(F.array_join(lines, "\n"))
    if options.endings:
        c.rows = c.rows.withColumn("_ended", F.explode(F.array(ended_lines(c.col()))))
        c.step(with_ended(c.col(), F.col("_ended")), "periods_added", ended_count(F.col("_ended")))
        c.rows = c.rows.drop("_ended")
    c.add("after_chars", F.length(c.col()))
    c.add("lost_chars", F.col("before_chars") - F.col("after_chars"))
    for name in every:
        if name not in c.counters:
            c.add(name, F.lit(0))
    return c.rows


# ---------------------------------------------------------------- sanitizing

# What sanitizing recognises.
HTML_NAMES = "br|p|div|span|strong|em|b|i|u|a|li|ul|ol|h[1-6]|section|article|table|tr|td|script|style|code|pre"
BLOCK_NAMES = "br|p|div|li|ul|ol|section|article|table|tr|pre|h[1-6]"
HTML_ATTRIBUTES = r"(?:[ \t]+[\w:-]+[ \t]*=[ \t]*(?:\"[^\"]*\"|'[^']*'|[^\s<>]+))*[ \t]*"
ENTITY = r"(?i)&(?:(?:amp|#0*38|#x0*26);)*(?:#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]+);"
DECORATIVE_LINE = r"(?m)^[ \t]*[-—–*=~#■◆◇★☆█•●▪_│|]{3,}[ \t]*$"
WIDE_PUNCTUATION = ("。！？，；：（）＂＇", ".!?,;:()''")
INVISIBLE = r"[\x{FEFF}\x{200B}\x{2060}-\x{2064}\x{061C}\x{00AD}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"
OTHER_SCRIPT = r"[\x{0370}-\x{052F}\x{0590}-\x{05FF}\x{0E00}-\x{0EFF}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{0600}-\x{06FF}\x{0900}-\x{097F}]"
CJK_PUNCTUATION = r"[\x{3001}-\x{303F}]"
PICTURE = r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}"
EMOJI = rf"[{PICTURE}](?:[\x{{FE0E}}\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]|\x{{200D}}[{PICTURE}])*|[0-9#*]\x{{FE0F}}?\x{{20E3}}"
#: Rules by name, of sequences that UTF-8 gives where it is read as another encoding.
MOJIBAKE = (
    ("latin1-utf8", r"[ÃÄÅÆÂ][\x{80}-\x{BF}]"),
    ("latin1-vietnamese", r"á»[\x{80}-\x{BF}]"),
    ("cp1252-punctuation", r"â(?:€[™œž\x{80}-\x{9F}]|[\x{80}-\x{9F}])"),
    ("utf8-bom", "ï»¿"),
    ("utf8-emoji", r"ðŸ[\x{80}-\x{2FF}]{1,2}"),
)
ELLIPSIS = r"\.(?:[ \t]*\.){2,}(?:[ \t]*[.…])*|…(?:[ \t]*[.…])+"
HORIZONTAL = r"[^\S\n]{2,}|[^\S\n ]"
METADATA_LINE = r"(?m)^[ \t]*(?:chapter_id|source_url)\s*=.*$"
LABELS = {"link": "[đường dẫn]", "mail": "[email]"}

@dataclass(frozen=True)
class SanitizeOptions:
    """How prose is made ready for reading aloud; links and mails: keep, remove or replace (by a label)."""

    enabled: bool = True
    links: str = "remove"
    mails: str = "keep"
    emoji: bool = True
    html: bool = True
    markdown: bool = True
    sentence_per_line: bool = False
    blank_lines: int = 1
    abbreviations: Sequence[str] = B.ABBREVIATIONS
    boilerplate: Sequence[str] = ()
    footnotes: Sequence[str] = ()

    def __post_init__(self) -> None:
        if {self.links, self.mails} - {"keep", "remove", "replace"}:
            raise ValueError("links and mails: keep, remove or replace")
        if not 0 <= self.blank_lines <= 10:
            raise ValueError("blank_lines: 0 to 10")
        for pattern in (*self.boilerplate, *self.footnotes):
            re.compile(pattern)


# The steps' expressions, in the dialect that both engines share but for names of characters.
FIXED = {
    "line_end": r"\r\n|[\r\x{2028}\x{85}]",
    "entity": ENTITY,
    "damage": "|".join(p for _, p in MOJIBAKE),
    "invisible": INVISIBLE,
    "control": CONTROLS,
    "emoji": EMOJI,
    "picture": f"[{PICTURE}]",
    "joiner": r"[\x{200C}\x{200D}]",
    "spaces": HORIZONTAL,
    "comment": r"(?s)<!--.*?-->",
    "tag": rf"(?is)</?({HTML_NAMES}){HTML_ATTRIBUTES}/?>",
    "blocks": BLOCK_NAMES,
    "decoration": DECORATIVE_LINE,
    "fence": r"(?m)^[ \t]*```[^\n]*\n",
    "fence_end": r"(?m)^[ \t]*```[ \t]*$",
    "heading_mark": r"(?m)^[ \t]*(?:#{1,6}[ \t]+|>[ \t]?)",
    "link": r"\[([^\]\n]+)\]\(([^)\n]+)\)",
    "metadata": METADATA_LINE,
    "bullet": r"(?m)^[ \t]*[•●▪][ \t]*(.+)$",
    "wide": WIDE_PUNCTUATION,
    "ellipsis": ELLIPSIS,
    "two_periods": r"(?<!\.)\.[ \t]*\.(?!\.)",
    "repeated": r"[?!](?:[ \t]*[?!])+",
    "space_before": r"[ \t][ \t]*(?=[,.;:!?…%\)\]\}”’»])",
    "no_space_after": r"[.,!?…:;][.,!?…:;]*[\"'”’»\)\]\}」』】》〉]*(?=[^\W_]|[“«(\[])",
    "dash": r"(?m)^ *[-–—] *(?=[^\W\d_]|[\"“])",
    "line_space": r"(?m)^ +| +$",
    "spoken": "(?im)" + B.SPOKEN_HEADING.replace(r"\s", r"[^\S\n]") + ".*$",
    "sentence": rf"({B.ENDING})[ ]*(?=[^ \n])",
    "detected_cjk_chars": CJK,
    "detected_other_script_chars": OTHER_SCRIPT,
    "detected_cjk_punctuation": CJK_PUNCTUATION,
    "detected_replacement_chars": r"\x{FFFD}",
}


def sanitize_counters(options: SanitizeOptions = SanitizeOptions()) -> list[str]:
    """Names of the counters that sanitize adds with these options, in order."""
    if not options.enabled:
        return ["input_chars", "output_chars"]
    steps = {
        "removed_emoji": options.emoji, "preserved_script_joiners": True, "normalized_spaces": True, "removed_html_comments": options.html, "removed_html_tags": options.html,
        "removed_decorative_lines": True, "removed_urls": options.links == "remove", "replaced_urls": options.links == "replace", "removed_emails": options.mails == "remove", "replaced_emails": options.mails == "replace",
        "removed_metadata_lines": True, "removed_boilerplate_lines": bool(options.boilerplate), "removed_footnotes": bool(options.footnotes),
    }
    first = ["input_chars", "detected_mojibake_patterns", "double_quotes_normalized", "removed_invisible_chars", "removed_control_chars"]
    marks = ["normalized_ellipsis", "normalized_double_period", "collapsed_punctuation", "fixed_missing_spaces", "spacing_char_delta", "repaired_heading_boundaries"]
    return [*first, *(s for s, on in steps.items() if on), *marks, "detected_cjk_chars", "detected_other_script_chars", "detected_cjk_punctuation", "detected_replacement_chars", "output_chars"]


def sanitize(rows: DataFrame, options: SanitizeOptions = SanitizeOptions(), *, text_col: str = "text") -> DataFrame:
    """rows with the text made ready for reading aloud, and counters of what was done (sanitize_counters; columns of these names are replaced).

    Technical tokens (boundaries.protected_spans: links, addresses, paths, JSON objects of any
    depth, numbers and the like) and sequences of wrongly decoded text pass the steps on
    punctuation unchanged: they are held by their spans, nothing stands in for them. Each text is
    read and written by Python once, in small batches. removed_* and normalized_* count what the
    steps did, detected_* what the result still has. Null counts as an empty text; with enabled
    off the text is returned as it is. User expressions are in Python's dialect.
    """
    names = sanitize_counters(options)
    if not options.enabled:
        out = rows.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
        return out.withColumns({c: F.length(text_col).cast("long") for c in names})
    kind = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in names)])

    @F.arrow_udf(kind)
    def once(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from quire.functions.sanitizing import Sanitizer

        one = Sanitizer(options, FIXED, {"urls": LABELS["link"], "emails": LABELS["mail"]}, names)
        for batch in batches:
            texts, counts = [], []
            for text in batch:
                made, n = one(text.as_py())
                texts.append(made)
                counts.append(n)
            columns = zip(*counts, strict=True) if counts else [[]] * len(names)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["text", *names])

    kept = [c for c in rows.columns if c not in names]
    told = in_batches(rows).withColumn("_sane", once(F.col(text_col)))
    return told.select(*(F.col("_sane.text").alias(c) if c == text_col else F.col(c) for c in kept), *(F.col(f"_sane.{c}").alias(c) for c in names))


def suspicious(rows: DataFrame, key: str = "doc_id", *, text_col: str = "text", radius: int = 24) -> DataFrame:
    """key, rule, value, start, line, column, context: sequences of wrongly decoded text and replacement characters, a row each.

    Every rule is looked for by itself, so matches of several may overlap; of rules that match the
    very same place the first is named. Offsets are code points from 0, lines and columns count
    from 1. The text isn't normalized first. Only texts with a match go to Python.
    """
    rules = (*MOJIBAKE, ("replacement-char", r"\x{FFFD}"))
    own = rows.filter(F.col(text_col).rlike("|".join(p for _, p in rules))).select(key, F.col(text_col).alias("text"))
    kind = own.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        from quire.functions.sanitizing import python_pattern

        compiled = [(name, re.compile(python_pattern(p))) for name, p in rules]
        for batch in batches:
            source, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                breaks = [m.start() for m in re.finditer("\n", text)]
                spans: dict[tuple[int, int], str] = {}
                for name, pattern in compiled:
                    for m in pattern.finditer(text):
                        spans.setdefault(m.span(), name)
                for (a, b), name in sorted(spans.items()):
                    line = bisect_right(breaks, a - 1)
                    context = text[max(0, a - radius) : b + radius].replace("\r", "\\r").replace("\n", "\\n")
                    source.append(row)
                    found.append((name, text[a:b], a, line + 1, a - (breaks[line - 1] + 1 if line else 0) + 1, context))
            columns = zip(*found, strict=True) if found else [()] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, "rule", "value", "start", "line", "column", "context"])

    return in_batches(own).mapInArrow(run, f"{key} {kind}, rule string, value string, start long, line long, column long, context string")


def suspicious_report(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, rule, value, n, contexts: how often each value occurs, and its first three contexts that differ (by start, then text).

    Contexts are limited to three before they are shuffled together, so no value gathers more.
    """
    from pyspark.sql import Window as W

    of = [*keys, "rule", "value"]
    once = found.groupBy(*of, "context").agg(F.min("start").alias("start"))
    first = once.withColumn("nth", F.row_number().over(W.partitionBy(*of).orderBy("start", "context"))).filter("nth <= 3")
    contexts = first.groupBy(*of).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "context"))), lambda x: x["context"]).alias("contexts"))
    return found.groupBy(*of).agg(F.count(F.lit(1)).alias("n")).join(contexts, of)


def sanitize_warnings(sanitized: DataFrame, found: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, code, n, detail: what someone should look at before a sanitized text is read aloud, a row a kind.

    Of sanitize's rows characters of other scripts and joiners that were kept, with how many; of
    found (suspicious, of the text before) each value with its rule and place of its first occurrence.
    """
    kept = ("detected_cjk_chars", "detected_other_script_chars", "detected_cjk_punctuation", "preserved_script_joiners")
    pairs = F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in kept))
    out = sanitized.select(key, F.inline(F.filter(pairs, lambda p: p["n"] > 0))).select(key, "code", "n", F.lit("kept").alias("detail"))
    if found is None:
        return out
    at = F.min_by(F.concat(F.lit("line "), F.col("line"), F.lit(", char "), F.col("column")), "start")
    values = found.groupBy(key, "rule", "value").agg(F.count(F.lit(1)).alias("n"), at.alias("at"))
    return out.unionByName(values.select(key, F.col("rule").alias("code"), "n", F.concat("value", F.lit(" at "), "at").alias("detail")))


def prepare_chapters(chapters: DataFrame, cleaning: CleanOptions = CleanOptions(), sanitizing: SanitizeOptions = SanitizeOptions()) -> DataFrame:
    """Chapters with header and text cleaned by the user's rules and sanitized, each by itself, chars, and counters summed over both.

    What a repaired header gives off goes to the text's beginning.
    """
    safe = cleaning.for_speech()
    body = sanitize(clean(chapters, safe), sanitizing)
    counters = [x for x in body.columns if x not in chapters.columns]
    once = body.select(*chapters.columns, F.struct(*counters).alias("_body"))
    both = sanitize(clean(once, safe, text_col="header"), sanitizing, text_col="header")
    parts = F.split(F.col("header"), "\n\n", 2)
    text = F.when(F.size(parts) > 1, F.concat(F.get(parts, F.lit(1)), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    kept = [F.get(parts, F.lit(0)).alias("header") if x == "header" else text.alias("text") if x == "text" else F.length(text).alias("chars") if x == "chars" else F.col(x) for x in chapters.columns]
    return both.select(*kept, *((F.col(x) + F.col(f"_body.{x}")).alias(x) for x in counters))
