"""Chapters and headings of long texts: lines, headers, sections, duplicates.

A text is exploded into lines, header lines are told by patterns in order of priority, a
running count numbers the sections and an ordered aggregation joins their lines again:
gaps and islands, one shuffle on the text's key. Nothing runs over a whole table in one
partition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import expressions as X
from quire.functions.numerals import NUMBER_TOKEN, clean_header, clean_header_count, format_header, parse_number
from quire.functions.text import HAN, LATIN, SPACE, char_count, end_sentences, language_of, normalize_spacing, quotes_to_single, restore_newlines, strip
from quire.session import persist_table

# Prefixes, units, decorations and separators of headers.
DECORATION = r"[ \t\n\r\f\x0B\x{A0}\x{3000}>»\-–—*#【\[（\(★\]】）\)〔〕《》〈〉「」『』]"
VIETNAMESE = "Chương hồi|Chương|Chuong|Hồi|Hoi|Quyển|Quyen|Phần|Phan|Tập|Tap"
ENGLISH = r"Chapter|Chap\.?|Book|Part|Volume|Vol\.?|Episode|Ep\.?"
CHINESE_UNITS = "[章節节回卷話话囘集]"
CHINESE_CLOSERS = r"\]】）)〕》〉」』〗"
SEPARATORS = r":：\-–—、,，"
CLOCK_TRIM = r"[ \t\x{3000}【】\[\]〔〕（）()《》〈〉「」『』★#*·・,.;:!?…–—\-]"
CLOCK = r"^[0-9]{1,3}:[0-9]{2}(?::[0-9]{2})?(?:\s*[—–-]\s*\S.*)?$"
LONGEST_HEADER, LONGEST_CLOCK, SHORTEST_GLUED = 200, 40, 4
HEADER_MARKERS = ("chương", "chuong", "hồi", "hoi", "quyển", "quyen", "phần", "phan", "tập", "tap", "chapter", "chap", "book", "part", "volume")

_GAP = r"[\s.,:：\-–—]*"
_TITLE = r"(?:\s*[.:：\-–—、,，]\s*(.*))?$"


@dataclass(frozen=True)
class HeaderPattern:
    """A header rule; number and title (0: none) are groups of the expression.

    head tells the beginning of a line that goes on right after its header (with the number in
    group 1); empty where such lines aren't looked for.
    """

    name: str
    language: str
    regex: str
    number: int
    title: int
    head: str = ""


#: In order of priority.
PATTERNS = (
    HeaderPattern("vietnamese", "vi", rf"(?iuU)^{DECORATION}*({VIETNAMESE}){_GAP}({NUMBER_TOKEN}){_TITLE}", 2, 3, rf"(?iuU)^{DECORATION}*(?:{VIETNAMESE}){_GAP}({NUMBER_TOKEN})"),
    HeaderPattern("english", "en", rf"(?iuU)^{DECORATION}*({ENGLISH}){_GAP}({NUMBER_TOKEN}){_TITLE}", 2, 3, rf"(?iuU)^{DECORATION}*(?:{ENGLISH}){_GAP}({NUMBER_TOKEN})"),
    HeaderPattern("chinese", "zh", rf"(?U)^{DECORATION}*(第)\s*({NUMBER_TOKEN})\s*{CHINESE_UNITS}(?:\s*[.:：\-–—、,，]\s*(.*?))?$", 2, 3, rf"(?U)^{DECORATION}*第\s*({NUMBER_TOKEN})\s*{CHINESE_UNITS}"),
)
PLAIN = HeaderPattern("plain", "vi", rf"(?U)^{DECORATION}*(#?)\s*({NUMBER_TOKEN})\s*(?:[.:：、)]|\s-\s|\s–\s|\s—\s)\s*(.*)$", 2, 3)
#: What every header by PATTERNS begins with; a cheap test before the full ones.
PREFIXED = rf"(?iu)^{DECORATION}*(?:第|{VIETNAMESE}|{ENGLISH})"


def custom_pattern(regex: str) -> HeaderPattern:
    """A user's header rule in Python's dialect, with the chapter number in a group (?P<number>...) and perhaps a (?P<title>...).

    Raises a ValueError if it is empty, doesn't compile or has no such group.
    """
    regex = regex.strip()
    if not regex:
        raise ValueError("the custom expression is empty")
    if reason := X.problem(regex):
        raise ValueError(f"the custom expression doesn't compile: {reason}")
    own = re.compile(regex).groupindex
    if "number" not in own:
        raise ValueError("the custom expression needs a group (?P<number>...)")
    return HeaderPattern("custom", "custom", regex, own["number"], own.get("title", 0), "")


def _match(body: Column, p: HeaderPattern) -> tuple[Column, Column, Column]:
    """Whether a line fits a rule, and the texts of its number and its title: a user's rule by Python's engine, others by the JVM's."""
    if p.name == "custom":
        found = X.groups(body, p.regex, ("number", "title"))
        return found.isNotNull(), F.coalesce(found["number"], F.lit("")), F.coalesce(found["title"], F.lit(""))
    return body.rlike(p.regex), F.regexp_extract(body, p.regex, p.number), F.regexp_extract(body, p.regex, p.title) if p.title else F.lit("")


def build_patterns(*, vietnamese: bool = True, english: bool = True, chinese: bool = True, plain: bool = False, custom: str = "") -> tuple[HeaderPattern, ...]:
    """The active rules in order of priority; plain numbered lines only on demand, since lists in prose look the same."""
    chosen = [p for p, use in zip(PATTERNS, (vietnamese, english, chinese), strict=True) if use]
    return (*((custom_pattern(custom),) if custom else ()), *chosen, *((PLAIN,) if plain else ()))


def is_clock(line: Column) -> Column:
    """Whether a line only shows a clock or a countdown, perhaps in brackets."""
    core = F.regexp_replace(line, rf"^{CLOCK_TRIM}+|{CLOCK_TRIM}+$", "")
    return (F.length(line) <= LONGEST_CLOCK) & core.rlike(CLOCK)


def _header(number: Column, title: Column, header: Column, body: Column, p: HeaderPattern, glued: Column) -> Column:
    return F.struct(number.alias("number"), title.alias("title"), header.alias("header"), body.alias("body"), F.lit(p.language).alias("language"), F.lit(p.name).alias("pattern"), glued.alias("glued"))


def _han_only(title: Column) -> Column:
    return title.rlike(HAN) & ~title.rlike(LATIN)


_GLUED_TITLE = r"(?s)^(.*?[\p{L}\p{N}])([A-Z\x{4E00}-\x{9FFF}].*)$"


def split_glued_title(title: Column) -> tuple[Column, Column]:
    """Title and body of a title that goes on as prose without a space, such as "Chạy trốnNàng vội vã"; else the title and an empty text."""
    head, body = strip(F.regexp_extract(title, _GLUED_TITLE, 1)), strip(F.regexp_extract(title, _GLUED_TITLE, 2))
    fits = (F.length(head) >= 2) & (F.length(body) >= 6) & F.contains(body, F.lit(" "))
    return F.when(fits, head).otherwise(title), F.when(fits, body).otherwise(F.lit(""))


def _line_header(body: Column, p: HeaderPattern) -> Column:
    _, found, raw = _match(body, p)
    number = parse_number(found)
    title = strip(F.regexp_replace(strip(raw), r"^[:：\-–—]+|[:：\-–—]+$", ""))
    if p.name == "chinese":
        at = F.regexp_replace(F.substring(body, F.lit(1), F.length(body) - F.length(raw)), rf"\s*[{SEPARATORS}]*\s*$", "")
        header = F.when(F.length(title) > 0, at).otherwise(body)
        own = _han_only(title)
        return _header(number, F.when(own, title).otherwise(F.lit("")), header, F.when(own, F.lit("")).otherwise(title), p, (F.length(title) > 0) & ~own)
    name, rest = split_glued_title(title)
    header = F.when(F.length(rest) > 0, strip(F.substring(body, F.lit(1), F.length(body) - F.length(rest)))).otherwise(body)
    return _header(number, name, header, rest, p, F.length(rest) > 0)


def _glued_header(body: Column, p: HeaderPattern) -> Column:
    number = parse_number(F.regexp_extract(body, p.head, 1))
    head = strip(F.regexp_extract(body, p.head, 0))
    rest = strip(F.regexp_replace(body, p.head, ""))
    if p.name != "chinese":
        fits = (F.length(rest) > 0) & (F.length(head) <= LONGEST_HEADER)
        return F.when(fits, _header(number, F.lit(""), head, rest, p, F.lit(True)))
    closing = F.regexp_replace(F.regexp_extract(rest, rf"^(?:[{CHINESE_CLOSERS}]\s*)*", 0), r"\s", "")
    content = strip(F.regexp_replace(rest, rf"^(?:[{CHINESE_CLOSERS}]\s*)*[{SEPARATORS}]*", ""))
    header, own = F.concat(head, closing), _han_only(content)
    none = F.length(content) == 0
    made = _header(number, F.when(own, content).otherwise(F.lit("")), header, F.when(own, F.lit("")).otherwise(content), p, F.lit(True))
    return F.when(none | (F.length(header) <= LONGEST_HEADER), made)


def header_of(line: Column, patterns: tuple[HeaderPattern, ...] = PATTERNS, glued: bool = True) -> Column:
    """number, title, header, body, language, pattern, glued of a header line; null for other lines.

    A line of at most LONGEST_HEADER characters that is a header as a whole comes first, by the
    first pattern that fits; then (glued) one that goes on right after its header. body is what
    belongs to the chapter's text: the part of a glued line after its header, a title in another
    script than Han after a Chinese header. Clocks are no headers, nor are numbers that overflow.
    """
    body = strip(line)
    whole = F.lit(None)
    for p in reversed(patterns):
        own = _line_header(body, p)
        timed = body.rlike(rf"^{DECORATION}*#?\s*[0-9]{{1,3}}:[0-9]{{2}}") if p.name == "plain" else F.lit(False)
        whole = F.when(_match(body, p)[0] & ~timed & own["number"].isNotNull(), own).otherwise(whole)
    out = F.when(F.length(body) <= LONGEST_HEADER, whole)
    if glued:
        part = F.lit(None)
        for p in reversed([p for p in patterns if p.head]):
            own = _glued_header(body, p)
            part = F.when(body.rlike(p.head) & own["number"].isNotNull(), own).otherwise(part)
        out = F.coalesce(out, F.when(F.length(body) >= SHORTEST_GLUED, part))
    known = body.rlike(PREFIXED) if set(patterns) <= set(PATTERNS) else F.length(body) > 0
    return F.when(known & ~is_clock(body), out)


def glued_header(line: Column) -> Column:
    """head, number and body of a line that goes on right after its header; null for others and for plain headers."""
    h = header_of(line)
    return F.when(h["glued"] & (F.length(h["body"]) > 0), F.struct(h["header"].alias("head"), h["number"].alias("number"), h["body"].alias("body")))


def lines(texts: DataFrame, key: str = "source") -> DataFrame:
    """key, line_index, line of texts (key, text)."""
    return texts.select(key, F.posexplode_outer(F.split("text", "\n", -1)).alias("line_index", "line")).filter("line is not null")


def told_lines(texts: DataFrame, key: str = "source", patterns: tuple[HeaderPattern, ...] = PATTERNS, glued: bool = True) -> DataFrame:
    """lines with h (header_of). h is made by a generator, so that no filter on it works it out once more."""
    return lines(texts, key).withColumn("h", F.explode(F.array(header_of(F.col("line"), patterns, glued))))


def headers(texts: DataFrame, key: str = "source", patterns: tuple[HeaderPattern, ...] = PATTERNS, glued: bool = True) -> DataFrame:
    """key, line_index, line, number, title, header, body, language, pattern, glued of the header lines."""
    told = told_lines(texts, key, patterns, glued).filter("h is not null")
    return told.select(key, "line_index", "line", "h.*")


def largest_numbers(texts: DataFrame, keys: list[str], patterns: tuple[HeaderPattern, ...] = PATTERNS) -> DataFrame:
    """keys, number: the largest number of a header in each text that has one. Lines leave their task only as one number a text and task."""
    found = headers(texts.select(F.struct(*keys).alias("_id"), "text"), "_id", patterns).groupBy("_id").agg(F.max("number").alias("number"))
    return found.select(*(F.col(f"_id.{k}").alias(k) for k in keys), "number")


def auto_headers(sources: DataFrame, key: str = "grp", *, prefix: str = "Chương {n}", continuous: bool = True, patterns: tuple[HeaderPattern, ...] = PATTERNS) -> DataFrame:
    """Sources (key, ord, text) with number (the largest of their headers), assigned, injected, and a header put before the texts that have none: numbered on from the last headed one, or (continuous off) 1, 2, 3 ..."""
    from quire.operators import records

    numbers = largest_numbers(sources, [key, "ord"], patterns)
    known = sources.join(numbers, [key, "ord"], "left")
    return records.put_headers(records.insert_headers(known, key, continuous=continuous), prefix)


def chapters(texts: DataFrame, key: str = "source", patterns: tuple[HeaderPattern, ...] = PATTERNS) -> DataFrame:
    """key, section, number, header_line, title, language, source_line, text, chars, glued; section 0 is what stands before the first header.

    What follows a header on its own line is the first line of its text. Line ends around a
    text are dropped, but for section 0.
    """
    told = told_lines(texts, key, patterns)
    order = W.partitionBy(key).orderBy("line_index")
    told = told.withColumn("section", F.count("h").over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = F.when(F.col("h").isNull(), F.col("line")).otherwise(F.nullif(F.col("h.body"), F.lit("")))
    body = F.when(own.isNotNull(), F.struct("line_index", own.alias("line")))
    joined = told.groupBy(key, "section").agg(
        F.first("h", ignorenulls=True).alias("h"),
        F.min("line_index").alias("source_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["line"]), "\n").alias("body"),
    )
    text = F.when(F.col("section") > 0, F.regexp_replace("body", r"\A\n+|\n+\z", "")).otherwise(F.col("body"))
    return joined.select(key, "section", "h.number", F.col("h.header").alias("header_line"), "h.title", "h.language", "source_line", text.alias("text"), F.length(text).alias("chars"), F.coalesce("h.glued", F.lit(False)).alias("glued"))


def language_rank(language: Column, prefer_vietnamese: bool = True) -> Column:
    """Rank by which variants of a chapter are chosen."""
    return F.when(language == "vi", 3).when(language == "mixed", 2).when(language == "en", 1).when(language == "zh", -1 if prefer_vietnamese else 1).otherwise(0)


def rank_variants(found: DataFrame, key: str = "source", prefer_vietnamese: bool = True) -> DataFrame:
    """Chapters with rank (1 stays) among those of the same key and number, and reason (why others go)."""
    order = [language_rank(F.col("language"), prefer_vietnamese).desc(), (F.length(F.trim(F.coalesce("title", F.lit("")))) > 0).desc(), F.col("chars").desc(), F.col("source_line")]
    same = W.partitionBy(key, "number").orderBy(*order)
    titled = F.length(F.trim(F.coalesce("title", F.lit("")))) > 0
    best = F.first(F.struct("language", "chars", titled.alias("titled"))).over(same)
    out = found.withColumn("rank", F.row_number().over(same)).withColumn("best", best)
    reason = (
        F.when(F.col("rank") == 1, F.lit(None))
        .when((F.col("language") == "zh") & F.col("best.language").isin("vi", "mixed", "en"), "language")
        .when(F.col("best.titled") & ~titled, "no_title")
        .when(F.col("chars") < F.col("best.chars"), "shorter")
        .when(F.col("chars") == F.col("best.chars"), "same")
        .otherwise("lower_rank")
    )
    return out.withColumn("reason", reason).drop("best")


def dedupe(found: DataFrame, key: str = "source", prefer_vietnamese: bool = True) -> DataFrame:
    """The best variant of each chapter number."""
    order = [language_rank(F.col("language"), prefer_vietnamese).desc(), (F.length(F.trim(F.coalesce("title", F.lit("")))) > 0).desc(), F.col("chars").desc(), F.col("source_line")]
    return found.withColumn("rank", F.row_number().over(W.partitionBy(key, "number").orderBy(*order))).filter("rank = 1").drop("rank")


@dataclass(frozen=True)
class NormalizeOptions:
    """How chapters are made canonical."""

    prefix: str = "Chương {n}"
    separator: str = ": "
    zero_pad: int = 0
    keep_headers: bool = False
    dedupe: bool = True
    prefer_vietnamese: bool = True
    newlines: bool = True
    spacing: bool = True
    endings: bool = True


def drop_repeated_header(body: Column, number: Column) -> tuple[Column, Column]:
    """Text without blank lines and repetitions of its header at its beginning; and whether any stood there."""
    every = F.split(body, "\n", -1)
    digits = number.cast("string")

    def stays(line: Column) -> Column:
        first = F.lower(F.regexp_replace(strip(line), r"^[:：\-–—]+|[:：\-–—]+$", ""))
        marked = first.rlike(rf"^(?:{'|'.join(HEADER_MARKERS)})") & F.contains(strip(line), digits)
        return (F.length(strip(line)) > 0) & ~marked

    first = F.array_position(F.transform(every, stays), True)
    begins = body.rlike(rf"(?iu)\A\s*[:：\-–—]*(?:{'|'.join(HEADER_MARKERS)})") | body.rlike(r"\A\s*\n")
    rest = F.when(first > 0, F.array_join(F.slice(every, first.cast("int"), F.size(every)), "\n")).otherwise(F.lit(""))
    gone = begins & (first != 1) & (F.length(strip(body)) > 0)
    return F.when(gone, rest).otherwise(body), gone


def clean_chapters(found: DataFrame, options: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    """Chapters (of chapters()) with canonical header, title, text and chars, and counters: raw_chars, repeated_header,
    header_marks, restored_newlines, periods_added, quotes, chinese_title_removed."""
    out = found.withColumn("raw_chars", F.length("text"))
    body, repeated = drop_repeated_header(F.col("text"), F.col("number"))
    out = out.withColumn("repeated_header", repeated).withColumn("text", body)
    newlines, spaced = restore_newlines(F.col("text")), lambda t: normalize_spacing(t) if options.spacing else t
    out = out.withColumn("restored_newlines", newlines[1] if options.newlines else F.lit(0).cast("long")).withColumn("text", spaced(newlines[0] if options.newlines else F.col("text")))
    removed = (F.col("language") == "zh") & (F.length(F.coalesce("title", F.lit(""))) > 0)
    title = F.when(F.col("language") == "zh", F.lit("")).otherwise(F.coalesce("title", F.lit("")))
    out = out.withColumn("chinese_title_removed", removed).withColumn("title", title)
    original = clean_header(F.col("header_line"))
    quotes = quotes_to_single(F.col("text"))[1] + quotes_to_single(F.col("title"))[1] + (quotes_to_single(original)[1] if options.keep_headers else F.lit(0))
    out = out.withColumn("quotes", quotes).withColumn("text", quotes_to_single(F.col("text"))[0]).withColumn("title", quotes_to_single(F.col("title"))[0])
    ended = end_sentences(F.col("text"))
    out = out.withColumn("periods_added", ended[1] if options.endings else F.lit(0).cast("long")).withColumn("text", strip(ended[0] if options.endings else F.col("text")))
    made = format_header(F.col("number"), F.col("title"), prefix=options.prefix, separator=options.separator, zero_pad=options.zero_pad)
    header = quotes_to_single(original)[0] if options.keep_headers else made
    out = out.withColumn("header_marks", clean_header_count(F.col("header_line")) if options.keep_headers else F.lit(0).cast("long"))
    return out.withColumn("header", header).withColumn("chars", F.length("text"))


def normalize(texts: DataFrame, key: str = "source", options: NormalizeOptions = NormalizeOptions(), patterns: tuple[HeaderPattern, ...] = PATTERNS) -> DataFrame:
    """key, number, header, title, text, chars, source_line, text_loss: canonical chapters, the best of each number.

    text_loss: characters that cleaning took from the chapter's text. What stands before the
    first header is left out; a text without headers has no row.
    """
    cleaned = clean_chapters(chapters(texts, key, patterns).filter("section > 0"), options)
    kept = dedupe(cleaned, key, options.prefer_vietnamese) if options.dedupe else cleaned
    return kept.select(key, "number", "header", "title", "text", "chars", "source_line", F.greatest(F.col("raw_chars") - F.col("chars"), F.lit(0)).alias("text_loss"))


def normalize_report(texts: DataFrame, key: str = "source", options: NormalizeOptions = NormalizeOptions(), patterns: tuple[HeaderPattern, ...] = PATTERNS) -> DataFrame:
    """A row per key: chapters found and kept, and what normalizing did, as counters."""
    found = chapters(texts, key, patterns)
    before = found.filter("section = 0").groupBy(key).agg(F.sum(char_count(F.col("text"), "\"“”„‟＂")).alias("preamble_quotes"))
    cleaned = clean_chapters(found.filter("section > 0"), options)
    ranked = rank_variants(cleaned, key, options.prefer_vietnamese)
    stays = F.col("rank") == 1 if options.dedupe else F.lit(True)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    sums = ranked.groupBy(key).agg(
        F.count(F.lit(1)).alias("found"),
        count(stays).alias("chapters"),
        count(F.col("glued")).alias("glued_splits"),
        (count(F.col("repeated_header")) + F.sum("header_marks")).alias("header_artifacts_removed"),
        F.sum("restored_newlines").alias("restored_newlines"),
        F.sum("periods_added").alias("periods_added"),
        count(F.col("chinese_title_removed")).alias("chinese_titles_removed"),
        F.sum("quotes").alias("quotes"),
        F.sum(F.when(~stays, F.col("chars")).otherwise(0)).cast("long").alias("discarded_chars"),
        F.sum(F.when(stays, F.greatest(F.col("raw_chars") - F.col("chars"), F.lit(0))).otherwise(0)).cast("long").alias("text_loss"),
    )
    return sums.join(before, key, "left").withColumn("double_quotes_normalized", F.col("quotes") + F.coalesce("preamble_quotes", F.lit(0))).drop("quotes", "preamble_quotes")


def loss_diagnostics(normalized: DataFrame, key: str = "source") -> DataFrame:
    """key, number, text_loss, severity of normalized chapters that lost 50 characters or more; warnings from 100 on."""
    return normalized.filter("text_loss >= 50").select(key, "number", "text_loss", F.when(F.col("text_loss") >= 100, "warning").otherwise("info").alias("severity"))


def renumber(found: DataFrame, key: str = "source", first: int = 1, options: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    """Chapters numbered anew by source_line from first on, with canonical headers; changed: whether the number did."""
    number = (F.row_number().over(W.partitionBy(key).orderBy("source_line")) + (first - 1)).cast("long")
    out = found.withColumn("before", F.col("number")).withColumn("number", number)
    changed = F.col("before") != F.col("number")
    made = format_header(F.col("number"), F.col("title"), prefix=options.prefix, separator=options.separator, zero_pad=options.zero_pad)
    return out.withColumn("changed", changed).withColumn("header", F.when(changed, made).otherwise(F.col("header"))).drop("before")


def repair_headers(found: DataFrame, options: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    """Chapters with canonical headers; changed: whether the header did."""
    made = format_header(F.col("number"), F.col("title"), prefix=options.prefix, separator=options.separator, zero_pad=options.zero_pad)
    return found.withColumn("changed", ~F.col("header").eqNullSafe(made)).withColumn("header", made)


def script_language(found: DataFrame) -> DataFrame:
    """Chapters with the language that the scripts of title and text tell where the header's doesn't."""
    own = language_of(F.concat_ws(" ", "title", "text"))
    return found.withColumn("language", F.when(F.col("language").isin("vi", "en", "zh"), F.col("language")).otherwise(own))


def sequence_gaps(found: DataFrame, key: str = "source") -> DataFrame:
    """key, low, high, missing: the ranges of numbers that are missing between the least and the largest of a key, and how many each holds.

    Found from neighbours among the numbers that are there, so a number far off costs one row.
    """
    there = found.select(key, "number").distinct()
    told = there.withColumn("next", F.lead("number").over(W.partitionBy(key).orderBy("number"))).filter("next > number + 1")
    return told.select(key, (F.col("number") + 1).alias("low"), (F.col("next") - 1).alias("high"), (F.col("next") - F.col("number") - 1).alias("missing"))


def first_missing(gaps: DataFrame, most: int = 40, key: str = "source") -> DataFrame:
    """key, number: the least numbers, at most so many a key, of ranges (low, high) that don't overlap."""
    own = gaps.select(key, F.explode(F.sequence("low", F.least(F.col("high"), F.col("low") + (most - 1)))).alias("number"))
    return own.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy("number"))).filter(F.col("_nth") <= most).drop("_nth")


def sequence_report(found: DataFrame, key: str = "source", *, missing: int = 40, breaks: int = 10) -> DataFrame:
    """key, missing, first_missing, breaks, first_breaks of keys with gaps or neighbours out of order.

    How many numbers are missing and the least of them, how many neighbours aren't consecutive
    and the first of these (source_line, previous, number, kind), at most so many of each.
    The numbers are written as a table first, so that texts are searched once and not for each part.
    """
    found = persist_table(found.select(key, "source_line", "number"), "numbers")
    gaps = sequence_gaps(found, key)
    least = first_missing(gaps, missing, key).groupBy(key).agg(F.array_sort(F.collect_list("number")).alias("first_missing"))
    holes = gaps.groupBy(key).agg(F.sum("missing").alias("missing")).join(least, key)
    wrong = order_breaks(found, key)
    early = wrong.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy("source_line"))).filter(F.col("_nth") <= breaks)
    early = early.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_line", "previous", "number", "kind"))).alias("first_breaks"))
    steps = wrong.groupBy(key).agg(F.count(F.lit(1)).alias("breaks")).join(early, key)
    none = F.coalesce
    return holes.join(steps, key, "full").select(key, none("missing", F.lit(0)).alias("missing"), none("first_missing", F.array().cast("array<bigint>")).alias("first_missing"), none("breaks", F.lit(0)).alias("breaks"), "first_breaks")


def order_breaks(found: DataFrame, key: str = "source") -> DataFrame:
    """key, source_line, previous, number, kind of neighbours that aren't consecutive: repeat, reset or gap."""
    pairs = found.withColumn("previous", F.lag("number").over(W.partitionBy(key).orderBy("source_line"))).filter("previous is not null and number <> previous + 1")
    kind = F.when(F.col("number") == F.col("previous"), "repeat").when(F.col("number") < F.col("previous"), "reset").otherwise("gap")
    return pairs.select(key, "source_line", "previous", "number", kind.alias("kind"))


#: The line breaks that count for spans: ten characters, and CR LF as one.
LINE_BREAK = r"(?<=[\n\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}])|(?<=\r)(?!\n)"


_WITHIN = r"[^\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: A text with such a line: PREFIXED after white space at the beginning of any of its lines.
HAS_PREFIXED = rf"(?iu)(?:\A|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}])[{SPACE}&&{_WITHIN}]*+[{DECORATION}&&{_WITHIN}]*+(?:第|{VIETNAMESE}|{ENGLISH})"


def physical_lines(texts: DataFrame, key: str = "source") -> DataFrame:
    """key, line_index, physical (the line with its line break), line (without CR and LF at its end), start (in code points), total (of the text)."""
    told = texts.select(key, F.length("text").cast("long").alias("total"), F.posexplode(F.split("text", LINE_BREAK, -1)).alias("line_index", "physical")).filter("length(physical) > 0")
    before = F.sum(F.length("physical")).over(W.partitionBy(key).orderBy("line_index").rowsBetween(W.unboundedPreceding, -1))
    return told.select(key, "line_index", "physical", F.regexp_replace("physical", r"[\r\n]+\z", "").alias("line"), F.coalesce(before, F.lit(0)).alias("start"), "total")


def heading_number(line: Column, patterns: tuple[HeaderPattern, ...] = PATTERNS) -> Column:
    """Number of a line that is a heading: a header as a whole, or a Vietnamese or English one with its title after a space. Null for others."""
    body = strip(line)
    out = F.lit(None).cast("long")
    for p in reversed(patterns):
        fits, found, _ = _match(body, p)
        number = parse_number(found)
        if p.name in ("vietnamese", "english"):
            spaced = p.head.replace(f"({NUMBER_TOKEN})", f"((?>{NUMBER_TOKEN}))") + r"(?=$|[\s:：.\-–—])"
            number = parse_number(F.coalesce(F.nullif(F.regexp_extract(body, p.regex, p.number), F.lit("")), F.regexp_extract(body, spaced, 1)))
            fits = fits | body.rlike(spaced)
        if p.name == "plain":
            fits = fits & ~body.rlike(rf"^{DECORATION}*#?\s*[0-9]{{1,3}}:[0-9]{{2}}")
        out = F.when(fits & number.isNotNull(), number).otherwise(out)
    known = body.rlike(PREFIXED) if set(patterns) <= set(PATTERNS) else F.length(body) > 0
    return F.when(known & ~is_clock(body), out)


def heading_spans(texts: DataFrame, key: str = "source", patterns: tuple[HeaderPattern, ...] = PATTERNS) -> DataFrame:
    """key, number, heading, start, body_start, end, line: headings with their spans in code points of the untouched text.

    A span ends where the next begins, the last with the text. Line breaks are those of LINE_BREAK;
    line counts from 1. Texts without a line that begins as a header aren't cut into lines.
    """
    if set(patterns) <= set(PATTERNS):
        texts = texts.filter(F.col("text").rlike(HAS_PREFIXED))
    told = physical_lines(texts, key).withColumn("number", F.explode(F.array(heading_number(F.col("line"), patterns)))).filter("number is not null")
    end = F.coalesce(F.lead("start").over(W.partitionBy(key).orderBy("line_index")), F.col("total"))
    return told.select(key, "number", F.col("line").alias("heading"), "start", (F.col("start") + F.length("physical")).alias("body_start"), end.alias("end"), (F.col("line_index") + 1).cast("long").alias("line"))


def _range_label(first: Column, last: Column, one: Column) -> Column:
    return F.when(one, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def group_by_count(spans: DataFrame, size: int, key: str = "source") -> DataFrame:
    """key, ord, label, range_label, start, end, chapters: consecutive headings, size to a group; the first begins at 0."""
    nth = F.row_number().over(W.partitionBy(key).orderBy("start")) - 1
    groups = spans.withColumn("ord", F.floor(nth / size) + 1).groupBy(key, "ord").agg(
        F.min_by("number", "start").alias("first_number"), F.max_by("number", "start").alias("last_number"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("chapters")
    )
    label = _range_label(F.col("first_number"), F.col("last_number"), F.col("chapters") == 1)
    return groups.select(key, "ord", F.concat(F.lit("Chương "), label).alias("label"), label.alias("range_label"), F.when(F.col("ord") == 1, 0).otherwise(F.col("start")).cast("long").alias("start"), "end", "chapters")


def analyze_grouping(spans: DataFrame, size: int, key: str = "source") -> DataFrame:
    """A row per text with headings: first_number, last_number, headings, expected_count, repeats, resets, gaps, needs_numbers, missing_starts, refusal.

    needs_numbers: numbers are missing, so that counting headings would give wrong ranges.
    missing_starts: ranges (low, high, n) of missing first numbers, size apart (listed_starts names them).
    refusal: why boundaries by number can't be had either (ambiguous: a number is repeated or
    numbering starts again; missing_starts: a group would begin at a heading that isn't there),
    or not_needed.
    """
    order = W.partitionBy(key).orderBy("start")
    before = spans.withColumn("previous", F.lag("number").over(order))
    step = F.col("number") - F.col("previous")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = before.groupBy(key).agg(
        F.min_by("number", "start").alias("first_number"),
        F.max_by("number", "start").alias("last_number"),
        F.count(F.lit(1)).alias("headings"),
        count(step == 0).alias("repeats"),
        count(step < 0).alias("resets"),
        count(step > 1).alias("gaps"),
        F.collect_set("number").alias("numbers"),  # of one text
    )
    out = out.withColumn("expected_count", F.col("last_number") - F.col("first_number") + 1)
    needs = (F.col("gaps") > 0) & (F.col("expected_count") > 0) & (F.col("headings") < F.col("expected_count"))
    # groups whose first heading is there, in order; what lies between two of them has no start
    own = F.filter("numbers", lambda x: (x >= F.col("first_number")) & (x <= F.col("last_number")) & ((x - F.col("first_number")) % size == 0))
    at = F.array_sort(F.transform(own, lambda x: F.floor((x - F.col("first_number")) / size)))
    after = F.floor((F.col("last_number") - F.col("first_number")) / size) + 1
    number = lambda group: F.col("first_number") + group * size
    holes = F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(after)), lambda a, b: F.struct(number(a + 1).alias("low"), number(b - 1).alias("high"), (b - a - 1).alias("n")))
    out = out.withColumn("needs_numbers", needs).withColumn("missing_starts", F.when(needs, F.filter(holes, lambda h: h["n"] > 0)))
    refusal = F.when(~F.col("needs_numbers"), "not_needed").when((F.col("repeats") > 0) | (F.col("resets") > 0), "ambiguous").when(F.size("missing_starts") > 0, "missing_starts")
    return out.withColumn("refusal", refusal).drop("numbers")


def listed_starts(missing_starts: Column, size: int, most: int = 1000) -> Column:
    """The first of the numbers in ranges (low, high, n) of missing_starts."""
    each = F.transform(missing_starts, lambda r: F.sequence(r["low"], F.least(r["high"], r["low"] + (most - 1) * size), F.lit(size).cast("long")))
    return F.slice(F.flatten(each), 1, most)


def group_by_number(spans: DataFrame, size: int, key: str = "source") -> DataFrame:
    """key, ord, label, range_label, start, end, chapters: headings by ranges of their numbers from the text's first.

    Only texts for which analyze_grouping has no refusal have groups. A group begins at the
    heading of its first number, the first one at 0, and ends where the next begins.
    """
    fine = analyze_grouping(spans, size, key).filter("refusal is null").select(key, "first_number", "last_number")
    own = spans.join(fine, key).withColumn("ord", F.floor((F.col("number") - F.col("first_number")) / size) + 1)
    groups = own.groupBy(key, "ord", "first_number", "last_number").agg(F.count(F.lit(1)).alias("chapters"), F.min("start").alias("start"), F.max("end").alias("end"))
    low = F.col("first_number") + (F.col("ord") - 1) * size
    high = F.least(low + size - 1, F.col("last_number"))
    label = _range_label(low, high, low == high)
    return groups.select(key, "ord", F.concat(F.lit("Chương "), label).alias("label"), label.alias("range_label"), F.when(F.col("ord") == 1, 0).otherwise(F.col("start")).cast("long").alias("start"), "end", "chapters")


def plan_groups(spans: DataFrame, size: int, method: str = "detected", key: str = "source") -> DataFrame:
    """Groups by count (method detected) or by number (numeric), only of the texts for which that method is right."""
    if size < 1 or method not in ("detected", "numeric"):
        raise ValueError("size must be positive, method detected or numeric")
    if method == "numeric":
        return group_by_number(spans, size, key)
    wrong = analyze_grouping(spans, size, key).filter("needs_numbers").select(key)
    return group_by_count(spans.join(wrong, key, "left_anti"), size, key)


#: To be raised whenever detection changes in a way that can move a boundary.
SCANNER_VERSION = "spans-2"


def numeric_fingerprint(spans: DataFrame, texts: DataFrame, size: int, key: str = "source", patterns: tuple[HeaderPattern, ...] = PATTERNS) -> DataFrame:
    """key, fingerprint: SHA-256 of what boundaries by number depend on (text, rules, first and last number, size, ranges, offsets of their starts)."""
    groups = group_by_number(spans, size, key)
    ranges = groups.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "range_label", "start"))).alias("ranges"))  # of one text
    ends = spans.groupBy(key).agg(F.min_by("number", "start").alias("first_number"), F.max_by("number", "start").alias("last_number"))
    rules = "\n".join(f"{p.name} {p.regex}" for p in patterns)
    hashed = texts.select(key, F.sha2("text", 256).alias("source_sha256"))
    joined = ranges.join(ends, key).join(hashed, key)
    facts = F.to_json(F.struct("source_sha256", F.lit(SCANNER_VERSION).alias("scanner"), F.sha2(F.lit(rules), 256).alias("rules"), "first_number", "last_number", F.lit(size).alias("size"), "ranges"))
    return joined.select(key, F.sha2(facts, 256).alias("fingerprint"))


def group_identity(groups: DataFrame, texts: DataFrame, size: int, key: str = "source", fingerprints: DataFrame | None = None) -> DataFrame:
    """Groups with group_id: 24 hex digits of the SHA-256 of the text's digest, its title (the key), size, ord, start and end, and for groups by number the fingerprint."""
    out = groups.join(texts.select(key, F.sha2("text", 256).alias("source_sha256")), key)
    parts = ["source_sha256", key, F.lit(str(size)), *(F.col(c).cast("string") for c in ("ord", "start", "end"))]
    if fingerprints is not None:
        out = out.join(fingerprints, key)
        parts += [F.lit("numeric_boundaries"), "fingerprint"]
    return out.withColumn("group_id", F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 24))


def group_texts(groups: DataFrame, texts: DataFrame, key: str = "source") -> DataFrame:
    """Groups with slice, the part of the text they cover, and its SHA-256. Each text is read once and cut where it stands."""
    own = [c for c in groups.columns if c != key]
    lists = groups.groupBy(key).agg(F.collect_list(F.struct(*own)).alias("g"))  # of one text
    cut = lambda g: F.struct(*(g[c].alias(c) for c in own), F.substring(F.col("text"), (g["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int")).alias("slice"))
    out = texts.select(key, "text").join(lists, key).select(key, F.inline(F.transform("g", cut)))
    return out.withColumn("text_sha256", F.sha2("slice", 256))


def group_names(groups: DataFrame, key: str = "source") -> DataFrame:
    """Groups with name, that of their files: title and range, numbered where a range occurs again in the same text."""
    from quire.functions.text import slug

    name = F.concat_ws("_", slug(F.col(key)), F.col("range_label"))
    again = F.row_number().over(W.partitionBy(key, "range_label").orderBy("ord")) > 1
    return groups.withColumn("name", F.when(again, F.concat(name, F.lit("_group_"), F.lpad(F.col("ord").cast("string"), 3, "0"))).otherwise(name))


def exact_cover(groups: DataFrame, texts: DataFrame, key: str = "source") -> DataFrame:
    """key, covered: whether the groups follow one another from 0 to the text's end; false for texts without groups."""
    order = W.partitionBy(key).orderBy("start")
    joins = groups.withColumn("joins", F.col("start") == F.coalesce(F.lag("end").over(order), F.lit(0)))
    ends = joins.groupBy(key).agg(F.min("joins").alias("joins"), F.max("end").alias("last"))
    return texts.select(key, F.length("text").alias("size")).join(ends, key, "left").select(key, F.coalesce(F.col("joins") & (F.col("last") == F.col("size")), F.lit(False)).alias("covered"))
