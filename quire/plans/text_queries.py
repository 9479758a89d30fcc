"""Queries over text functions and numerals, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import numerals, text
from quire.operators import clean
from quire.plans.stimulus import DIRTY_SQL, dirty, documents

SYMBOLS = {"&": " và ", "%": " phần trăm ", "+": " cộng ", "...": " chấm chấm chấm "}


def _digested(spark: SparkSession, sf_dir: str, out: Column, **more: Column) -> DataFrame:
    """doc_id, length and digest of a result, and further columns, over the dirty documents."""
    rows = dirty(spark, sf_dir).withColumn("out", out)
    return rows.select("doc_id", F.length("out").cast("long").alias("chars"), F.sha2("out", 256).alias("sha"), *(c.alias(n) for n, c in more.items()))


def T() -> Column:
    return F.col("text")


def normalize_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = text.quotes_to_single(T())
    return _digested(spark, sf_dir, out, quotes=n)


def restore_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = text.restore_newlines(T())
    return _digested(spark, sf_dir, out, restored=n)


def normalize_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(spark, sf_dir, text.normalize_spacing(T()))


def sentence_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = text.end_sentences(T())
    return _digested(spark, sf_dir, out, added=n)


def strip_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(spark, sf_dir, text.strip_pairs(T()))


def remove_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(spark, sf_dir, text.strip_pairs(T(), mode="remove"))


def remove_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = text.remove_quotes(T())
    return _digested(spark, sf_dir, out, removed=n)


def symbol_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(spark, sf_dir, text.say_symbols(T(), SYMBOLS))


def control_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, control, zero = text.remove_invisible(T())
    return _digested(spark, sf_dir, out, control=control, zero_width=zero)


def unescape_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(spark, sf_dir, text.unescape_basic(T()))


def strip_html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(spark, sf_dir, text.strip_html(T()))


def strip_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = text.strip_html(F.col("html"))
    return pages.select("page_id", F.length(out).cast("long").alias("chars"), F.sha2(out, 256).alias("sha"))


_COUNTERS = ("before_chars", "after_chars", "control_chars", "zero_width", "html_tags", "html_entities", "bracket_pairs_removed", "quotes_removed", "symbols_replaced", "custom_rule_hits", "periods_added")
_RULES = (clean.Rule("(?i)the ([a-z])", r"\1-"), clean.Rule("e", "E", regex=False), clean.Rule("(", "x"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning pass, with rules of the user's (one that doesn't compile among them)."""
    out = clean.clean(dirty(spark, sf_dir), clean.CleanOptions(rules=_RULES, drop_empty_lines=True, endings=True))
    return out.select("doc_id", F.sha2("text", 256).alias("sha"), *_COUNTERS)


def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the cleaning pass by source."""
    out = clean.clean(dirty(spark, sf_dir))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), *(F.sum(c).alias(c) for c in _COUNTERS if c not in ("custom_rule_hits", "periods_added")))


def clean_for_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the user's rules."""
    out = clean.clean(dirty(spark, sf_dir), clean.CleanOptions(rules=_RULES).for_speech())
    return out.select("doc_id", F.sha2("text", 256).alias("sha"), "custom_rule_hits")


def has_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).groupBy("source").agg(F.sum(text.has_escaped_newlines(T()).cast("long")).alias("n"))


def numeral_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, TOKENS).select("doc_id", "token", numerals.is_numeral(F.col("token")).alias("is_numeral"))


def language_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("流民不可怕"), F.col("doc_id").cast("int") % 50)).otherwise("")
    told = documents(spark, sf_dir).withColumn("language", text.language_of(F.concat(F.coalesce(T(), F.lit("")), mixed)))
    return told.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def meaningful_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dirty(spark, sf_dir).select("source", F.explode(F.split(T(), "\n", -1)).alias("line"))
    return lines.groupBy("source").agg(F.count(F.lit(1)).alias("line_count"), F.sum(text.meaningful(F.col("line")).cast("long")).alias("meaningful"))


def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.sanitize(dirty(spark, sf_dir))
    return out.select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha"), "removed_invisible_chars", "removed_html_tags", "normalized_ellipsis", "double_quotes_normalized")


#: Texts of letters and spaces with what one step of sanitizing looks for.
STEPS = {
    "links": "concat(text, ' xem https://a.vn/x....y, rồi gửi a.b@c.org nhé')",
    "joiners": "concat(replace(text, ' a', ' \u200ca'), ' क्\u200dष')",
    "metadata": "concat('chapter_id=5\n', text, '\nsource_url = x y\n', text)",
    "marks": "concat(replace(text, ' e', ' .. . ! ! ?e'), ' 3.14 , v.v. ok')",  # after a blank: a word such as TS with a period is an abbreviation, which is held
    "markdown": "concat('# ', replace(text, ' a', ' **b** a'), '\n> q [t](u v) 2 * 3 snake_case_x')",
    "html": "concat(replace(text, ' o', '<br/> <b class=\"x\">o</b>'), ' <test> 1 < 2 <!-- c --> <!-- open')",
    "entities": "concat(text, ' &amp;amp; &eacute; e\u0301 &nosuch; &#65;')",
    "bullets": "concat('• ', text, '\n•x!\n- y\n****\n', text)",
}


def sanitize_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain texts with what one step looks for, a row for each document and step."""
    bare = F.trim(F.regexp_replace(T(), r"[^\p{L}]+", " "))  # letters and spaces, so that the other steps don't change them
    plain = documents(spark, sf_dir).select("doc_id", F.explode(F.array(bare)).alias("text"))
    made = plain.select("doc_id", F.inline(F.array(*(F.struct(F.lit(name).alias("step"), F.expr(x).alias("text")) for name, x in STEPS.items()))))
    return clean.sanitize(made).select("doc_id", "step", F.sha2("text", 256).alias("sha"))


def sanitize_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a second pass would change, by source: none."""
    once = clean.sanitize(dirty(spark, sf_dir)).select("source", "doc_id", T().alias("once"), T())
    return clean.sanitize(once).groupBy("source").agg(F.sum((T() != F.col("once")).cast("long")).alias("changed"))


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("source", "doc_id", F.when(F.col("doc_id") % 6 == 1, F.replace(F.replace(T(), F.lit("e "), F.lit("Ã© ")), F.lit("t."), F.lit("\ufffd."))).otherwise(T()).alias("text"))


def suspicious_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean.suspicious(_spoilt(spark, sf_dir))
    return found.groupBy("doc_id", "rule", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("line").alias("line_sum"), F.sum("column").alias("columns"), F.sum(F.length("context")).alias("context_chars"))


def mojibake_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspicious values by source: how many, and the first three contexts."""
    rows = _spoilt(spark, sf_dir)
    found = clean.suspicious(rows).join(rows.select("doc_id", "source"), "doc_id")
    return clean.suspicious_report(found, ["source"]).select("source", "rule", "value", "n", F.sha2(F.array_join("contexts", "|"), 256).alias("contexts"))


TOKENS = {"十五": 15, "九十八": 98, "一百零五": 105, "三千二百": 3200, "一万": 10000, "两万三千": 23000, "一亿": 100000000, "二十": 20, "零": 0, "一二": None, "零零": None, "万": None, "百": None, "十十": None, "一百二十三": 123, "壹佰贰拾叁": 123, "一千零一": 1001, "十万": 100000, "一零": None, "三百一千": None, "五万亿": None, "1234": 1234, "１２，３４５": 12345, "1,234": 1234, "abc": None, "": None}
ROMANS = {"I": 1, "iv": 4, "IX": 9, "XLII": 42, "MCMXCIV": 1994, "IIII": 4, "VX": 5, "ABC": None, "": None, "mmxxvi": 2026}


def _tokens(spark: SparkSession, sf_dir: str, values: dict) -> DataFrame:
    """Each document with a token by its id."""
    every = F.array(*(F.lit(t) for t in values))
    return documents(spark, sf_dir).select("doc_id", F.get(every, (F.col("doc_id") % len(values)).cast("int")).alias("token"))


def parse_number_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, TOKENS).withColumn("value", numerals.parse_number(F.col("token")))


def chinese_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {k: v for k, v in TOKENS.items() if "一" <= k[:1] <= "龥"}
    return _tokens(spark, sf_dir, values).withColumn("value", numerals.chinese_to_int(F.col("token")))


def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, ROMANS).withColumn("value", numerals.roman_to_int(F.col("token")))


def normalize_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.translate(F.col("doc_id").cast("string"), "0123456789", numerals.FULL_WIDTH)
    return documents(spark, sf_dir).select("doc_id", numerals.normalize_digits(F.concat(F.lit("１，"), wide)).alias("digits"))


def format_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" Tên "), F.col("lang"))).otherwise("")
    return documents(spark, sf_dir).select("doc_id", numerals.format_header(F.col("doc_id") % 2000, title, zero_pad=3).alias("header"))


def clean_header_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.concat(F.when(F.col("doc_id") % 2 == 0, "## ").otherwise("- #"), F.when(F.col("doc_id") % 3 == 0, "> **").otherwise(""), F.lit("Chương "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, " ==* ").otherwise(""))
    return documents(spark, sf_dir).select("doc_id", numerals.clean_header(marks).alias("header"))


def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.sha256(T()).alias("sha"), F.length(T()).cast("long").alias("chars"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit(" ._a/b:"), F.replace(T(), F.lit("\n"), F.lit(" ")))
    return documents(spark, sf_dir).select("doc_id", text.slug(name).alias("slug"))


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names in natural order, numbered by source."""
    from quire.operators.scan import Ranges

    name = F.concat(F.lit("Chap "), (F.col("doc_id") % 120).cast("string"), F.lit(" part"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    rows = documents(spark, sf_dir).select("source", name.alias("name"), text.natural_key(name).alias("key"))
    return Ranges(rows, ["source"], ["key"]).number("ord").rows().drop("key")


QUERIES = {f.__name__: f for f in (normalize_quotes, restore_newlines, normalize_spacing, sentence_endings, strip_brackets, remove_brackets, remove_quotes, symbol_words, control_chars, unescape_entities, strip_html_documents, strip_html_pages, clean_text, clean_report, clean_for_speech, has_escapes, numeral_texts, language_of, meaningful_lines, sanitize_text, sanitize_steps, sanitize_fixed_point, suspicious_values, mojibake_report, parse_number_token, chinese_numerals, roman_numerals, normalize_digits, format_header, clean_header_artifacts, text_fingerprints, slugs, natural_sort)}


def _sql(out: str, more: str = "") -> str:
    return f"WITH {DIRTY_SQL}, done AS (SELECT *, {out} AS out FROM dirty) SELECT doc_id, length(out) AS chars, sha256(out) AS sha{more} FROM done"


def _gsub(value: str, pattern: str, by: str, options: str = "g") -> str:
    return f"regexp_replace({value}, '{pattern}', '{by}', '{options}')"


_S = r"[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SPACED = "replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' ')"
for _p, _b in ((r"[ \t\x{A0}\x{3000}]{2,}", " "), (rf"{_S}+([,.;:!?%…)\]}}»”’])", r"\1"), (rf"([(\[{{«“‘]){_S}+", r"\1"), (r"(?m)[ \t\x{3000}]+$", ""), (r"\n{3,}", "' || chr(10) || chr(10) || '"), (r"\A\n+|\n+\z", "")):
    _SPACED = _gsub(_SPACED, _p, _b)
SPACED = _SPACED
_Q = text.DOUBLE_QUOTES
_R = text.REMOVED_QUOTES
_PAIRED = "text"
for _pair in text.BRACKET_PAIRS:
    _o, _c = ("\\" + x if x in "()[]{}" else "''" if x == "'" else x for x in _pair)
    _PAIRED = _gsub(_PAIRED, f"{_o}([^{_o}{_c}]*){_c}", r"\1")
_ALL = "".join(dict.fromkeys("".join(text.BRACKET_PAIRS))).replace("'", "''")
_SAID = "text"
for _k, _v in sorted(SYMBOLS.items(), key=lambda kv: -len(kv[0])):
    _SAID = f"replace({_SAID}, '{_k}', '{_v}')"
_TAGS = lambda c: _gsub(_gsub(_gsub(c, "<!--.*?-->", "", "gs"), r"<\s*/?\s*(?:p|br|div|li|tr|h[1-6]|section|article)\b[^<>]*>", "' || chr(10) || '", "gi"), "</?[a-zA-Z][^<>]{0,200}?>", "")
_LINES = "list_transform(string_split(text, chr(10)), lambda x: struct_pack(x := x, body := " + _gsub("x", rf"\A{_S}+|{_S}+\z", "") + ", trimmed := " + _gsub("x", rf"{_S}+\z", "") + "))"
_LACKS = "length(l.body) > 1 AND NOT contains('" + (text.SENTENCE_END + text.CLOSERS + text.PAUSES).replace("'", "''") + "', right(l.trimmed, 1)) AND regexp_matches(l.x, '[A-Za-zÀ-ỹ0-9\\x{4E00}-\\x{9FFF}]')"
ENDED_LINES, LACKS_ENDING = _LINES, _LACKS
_UNESC = "text"
for _e, _ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _UNESC = f"replace({_UNESC}, '{_e}', '{_ch}')"
_HIT = lambda p: f"len(regexp_extract_all(text, '{p}'))"


def _values(values: dict) -> str:
    rows = ", ".join(f"({i}, '{k}', {'NULL' if v is None else v})" for i, (k, v) in enumerate(values.items()))
    return f"SELECT doc_id, token, CAST(value AS BIGINT) AS value FROM documents JOIN (VALUES {rows}) t(i, token, value) ON doc_id % {len(values)} = i"


_QUOTED = f"length(text) - length(translate(text, '{_Q}', ''))"
def _RULED(t: str) -> str:
    return f"regexp_replace({t}, '(?i)the ([a-z])', '\\1-', 'g')"


def _count(pattern: str, t: str = "t", options: str = "") -> str:
    return f"len(regexp_extract_all({t}, '{pattern}', 0{options}))"


def _clean_sql() -> str:
    """The cleaning pass step by step: s0, s1, ... each with its text t and the counters so far."""
    control, zero = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]"
    steps = [f"s0 AS (SELECT doc_id, source, length(coalesce(text, '')) AS before_chars, coalesce(text, '') AS t FROM dirty)"]
    steps.append(f"s1 AS (SELECT * EXCLUDE (t), {_count(control)} AS control_chars, {_gsub('t', control, '')} AS t FROM s0)")
    steps.append(f"s2 AS (SELECT * EXCLUDE (t), {_count(zero)} AS zero_width, {_gsub('t', zero, '')} AS t FROM s1)")
    comment, block, tag = "(?s)<!--.*?-->", r"(?i)<\s*/?\s*(?:p|br|div|li|tr|h[1-6]|section|article)\b[^<>]*>", "</?[a-zA-Z][^<>]{0,200}?>"
    steps.append(f"s3a AS (SELECT * EXCLUDE (t), {_count(comment)} AS c1, {_gsub('t', comment, '')} AS t FROM s2)")
    steps.append("s3b AS (SELECT * EXCLUDE (t), " + _count(block) + " AS c2, " + _gsub("t", block, "' || chr(10) || '") + " AS t FROM s3a)")
    steps.append(f"s3 AS (SELECT * EXCLUDE (t, c1, c2), c1 + c2 + {_count(tag)} AS html_tags, {_gsub('t', tag, '')} AS t FROM s3b)")
    steps.append("s4 AS (SELECT * EXCLUDE (t), " + _count("&(?:amp|lt);") + " AS html_entities, replace(replace(t, '&lt;', '<'), '&amp;', '&') AS t FROM s3)")
    last = "s4"
    for k, pair in enumerate(text.BRACKET_PAIRS):
        a, b = ("\\" + x if x in "()[]{}" else "''" if x == "'" else x for x in pair)
        pattern = f"{a}([^{a}{b}]*){b}"
        before = "0" if k == 0 else "bracket_pairs_removed"
        drop = "" if k == 0 else ", bracket_pairs_removed"
        steps.append(f"b{k} AS (SELECT * EXCLUDE (t{drop}), {before} + {_count(pattern)} AS bracket_pairs_removed, " + _gsub("t", pattern, r"\1") + f" AS t FROM {last})")
        last = f"b{k}"
    steps.append(f"s5 AS (SELECT * EXCLUDE (t), length(t) - length(translate(t, '{_R}', '')) AS quotes_removed, translate(t, '{_R}', '') AS t FROM {last})")
    last = "s5"
    for k, (symbol, word) in enumerate(clean.SYMBOL_WORDS.items()):
        before, drop = ("0", "") if k == 0 else ("symbols_replaced", ", symbols_replaced")
        steps.append(f"y{k} AS (SELECT * EXCLUDE (t{drop}), {before} + length(t) - length(replace(t, '{symbol}', '')) AS symbols_replaced, replace(t, '{symbol}', '{word}') AS t FROM {last})")
        last = f"y{k}"
    steps.append(f"s6 AS (SELECT * EXCLUDE (t), t AS text, {_RULED('t')} AS t, {_count('(?i)the [a-z]')} AS hits FROM {last})")
    steps.append("s7 AS (SELECT * EXCLUDE (t, text, hits), " + _SPACED + " AS plain, hits + length(t) - length(replace(t, 'e', '')) AS custom_rule_hits, replace(t, 'e', 'E') AS text FROM s6)")
    steps.append("s8 AS (SELECT * EXCLUDE (text), array_to_string(list_filter(string_split(" + _SPACED + f", chr(10)), lambda x: regexp_matches(x, '[^{_S[1:]}')), chr(10)) AS text FROM s7)")
    steps.append(f"s8b AS (SELECT *, {_LINES} AS ls FROM s8)")
    steps.append(f"s9 AS (SELECT *, array_to_string(list_transform(ls, lambda l: CASE WHEN {_LACKS} THEN l.trimmed || '.' ELSE l.x END), chr(10)) AS t9, len(list_filter(ls, lambda l: {_LACKS})) AS periods_added FROM s8b)")
    return f"{DIRTY_SQL}, " + ", ".join(steps)


CLEAN_SQL = _clean_sql()
SPOILT_SQL = "spoilt AS (SELECT source, doc_id, CASE WHEN doc_id % 6 = 1 THEN replace(replace(text, 'e ', 'Ã© '), 't.', chr(65533) || '.') ELSE text END AS text FROM documents)"
_HITS = f"{SPOILT_SQL}, h AS (SELECT source, doc_id, text, unnest(regexp_extract_all(text, '(?s)(.*?)(Ã[\\x{{80}}-\\x{{BF}}]|\\x{{FFFD}})', 1)) AS before, unnest(regexp_extract_all(text, '(?s)(.*?)(Ã[\\x{{80}}-\\x{{BF}}]|\\x{{FFFD}})', 2)) AS value, generate_subscripts(regexp_extract_all(text, 'Ã[\\x{{80}}-\\x{{BF}}]|\\x{{FFFD}}'), 1) AS k FROM spoilt WHERE regexp_matches(text, 'Ã[\\x{{80}}-\\x{{BF}}]|\\x{{FFFD}}')), p AS (SELECT *, CAST(sum(length(before) + length(value)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(value) AS start FROM h), q AS (SELECT source, doc_id, CASE WHEN value = chr(65533) THEN 'replacement-char' ELSE 'latin1-utf8' END AS rule, value, start, left(text, start) AS upto, replace(replace(substring(text, greatest(start - 24, 0) + 1, start - greatest(start - 24, 0) + length(value) + 24), chr(13), chr(92) || 'r'), chr(10), chr(92) || 'n') AS context FROM p)"
_NL = "' || chr(10) || '"
STEP_SQL = {
    "links": "trim(text || ' xem , rồi gửi a.b@c.org nhé').replace(' ,', ',')",
    "joiners": "trim(text) || ' क्' || chr(8205) || 'ष'",
    "metadata": "trim(text || chr(10) || chr(10) || text)",
    "marks": "trim(replace(text, ' e', '…?! e')) || ' 3.14, v.v. ok'",
    "markdown": "trim(replace(text, ' a', ' b a')) || chr(10) || 'q t (u v) 2 * 3 snake_case_x'",
    "html": "regexp_replace(trim(replace(text, ' o', chr(10) || 'o')), ' *\\n *', chr(10), 'g') || ' <test> 1 < 2 <!-- open'",
    "entities": "trim(text || ' & é é &nosuch; A')",
    "bullets": "trim(text) || '.' || chr(10) || 'x!' || chr(10) || '— y' || chr(10) || chr(10) || text",
}
ORACLES = {
    "normalize_quotes": _sql(f"translate(text, '{_Q}', repeat(chr(39), 6))", f", {_QUOTED} AS quotes"),
    "restore_newlines": _sql(_gsub("text", r"\\r\\n|\\n|\\r", "' || chr(10) || '"), ", " + _HIT(r"\\r\\n|\\n|\\r") + " AS restored"),
    "normalize_spacing": _sql(_SPACED),
    "sentence_endings": f"WITH {DIRTY_SQL}, done AS (SELECT doc_id, {_LINES} AS ls FROM dirty), out AS (SELECT doc_id, array_to_string(list_transform(ls, lambda l: CASE WHEN {_LACKS} THEN l.trimmed || '.' ELSE l.x END), chr(10)) AS out, len(list_filter(ls, lambda l: {_LACKS})) AS added FROM done) SELECT doc_id, length(out) AS chars, sha256(out) AS sha, added FROM out",
    "strip_brackets": _sql(_PAIRED),
    "remove_brackets": _sql(f"translate(text, '{_ALL}', '')"),
    "remove_quotes": _sql(f"translate(text, '{_R}', '')", f", length(text) - length(translate(text, '{_R}', '')) AS removed"),
    "symbol_words": _sql(_SAID),
    "control_chars": _sql(_gsub(_gsub("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]", ""), ", " + _HIT(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]") + " AS control, " + _HIT(r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]") + " AS zero_width"),
    "unescape_entities": _sql(_UNESC),
    "strip_html_documents": _sql(_TAGS("text")),
    "strip_html_pages": f"SELECT page_id, length(out) AS chars, sha256(out) AS sha FROM (SELECT page_id, {_TAGS('html')} AS out FROM pages)",
    "clean_text": f"WITH {CLEAN_SQL} SELECT doc_id, sha256(t9) AS sha, before_chars, length(t9) AS after_chars, control_chars, zero_width, html_tags, html_entities, bracket_pairs_removed, quotes_removed, symbols_replaced, custom_rule_hits, periods_added FROM s9",
    "clean_report": f"WITH {CLEAN_SQL} SELECT source, count(*) AS docs, CAST(sum(before_chars) AS BIGINT) AS before_chars, CAST(sum(length(plain)) AS BIGINT) AS after_chars, CAST(sum(control_chars) AS BIGINT) AS control_chars, CAST(sum(zero_width) AS BIGINT) AS zero_width, CAST(sum(html_tags) AS BIGINT) AS html_tags, CAST(sum(html_entities) AS BIGINT) AS html_entities, CAST(sum(bracket_pairs_removed) AS BIGINT) AS bracket_pairs_removed, CAST(sum(quotes_removed) AS BIGINT) AS quotes_removed, CAST(sum(symbols_replaced) AS BIGINT) AS symbols_replaced FROM s9 GROUP BY source",
    "clean_for_speech": f"WITH {DIRTY_SQL}, r AS (SELECT doc_id, coalesce(text, '') AS t FROM dirty) SELECT doc_id, sha256(replace({_RULED('t')}, 'e', 'E')) AS sha, len(regexp_extract_all(t, '(?i)the [a-z]')) + length({_RULED('t')}) - length(replace({_RULED('t')}, 'e', '')) AS custom_rule_hits FROM r",
    "has_escapes": f"WITH {DIRTY_SQL} SELECT source, count(*) FILTER (regexp_matches(text, '\\\\[rn]')) AS n FROM dirty GROUP BY source",
    "numeral_texts": f"SELECT doc_id, token, regexp_matches(token, '^[0-9０-９零〇洞一二两三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬億]+$') AS is_numeral FROM ({_values(TOKENS)})",
    "sanitize_steps": " UNION ALL ".join(f"SELECT doc_id, '{name}' AS step, sha256({sql}) AS sha FROM (SELECT doc_id, trim(regexp_replace(text, '[^\\p{{L}}]+', ' ', 'g')) AS text FROM documents)" for name, sql in STEP_SQL.items()),
    "suspicious_values": f"WITH {_HITS} SELECT doc_id, rule, value, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(length(upto) - length(replace(upto, chr(10), '')) + 1) AS BIGINT) AS line_sum, CAST(sum(length(regexp_replace(upto, '(?s)^.*\\n', '')) + 1) AS BIGINT) AS columns, CAST(sum(length(context)) AS BIGINT) AS context_chars FROM q GROUP BY ALL",
    "mojibake_report": f"WITH {_HITS}, o AS (SELECT source, rule, value, context, count(*) AS n, min(start) AS start FROM q GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, rule, value ORDER BY start, context) AS nth FROM o) SELECT source, rule, value, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(context, '|' ORDER BY nth) FILTER (nth <= 3)) AS contexts FROM r GROUP BY source, rule, value",
    "language_of": "WITH t AS (SELECT coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN repeat('流民不可怕', doc_id % 50) ELSE '' END AS text FROM documents), n AS (SELECT len(regexp_extract_all(text, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]')) AS han, len(regexp_extract_all(text, '[A-Za-zÀ-ỹ]')) AS latin FROM t) SELECT CASE WHEN han > latin * 0.5 THEN 'zh' WHEN han > 0 AND latin > 0 THEN 'mixed' WHEN latin > 0 THEN 'vi' ELSE 'unknown' END AS language, count(*) AS n FROM n GROUP BY 1",
    "meaningful_lines": f"WITH {DIRTY_SQL}, l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM dirty) SELECT source, count(*) AS line_count, CAST(sum(CAST(regexp_matches(line, '[\\p{{L}}\\p{{N}}]') AS INT)) AS BIGINT) AS meaningful FROM l GROUP BY source",
    "sanitize_fixed_point": "SELECT source, CAST(0 AS BIGINT) AS changed FROM documents GROUP BY source",
    "parse_number_token": _values(TOKENS),
    "chinese_numerals": _values({k: v for k, v in TOKENS.items() if "一" <= k[:1] <= "龥"}),
    "roman_numerals": _values(ROMANS),
    "normalize_digits": "SELECT doc_id, '1' || CAST(doc_id AS VARCHAR) AS digits FROM documents",
    "format_header": "SELECT doc_id, 'Chương ' || CASE WHEN doc_id % 2000 < 1000 THEN lpad(CAST(doc_id % 2000 AS VARCHAR), 3, '0') ELSE CAST(doc_id % 2000 AS VARCHAR) END || CASE WHEN doc_id % 2 = 0 THEN ': Tên ' || lang ELSE '' END AS header FROM documents",
    "clean_header_artifacts": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN '' WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN '#> **' WHEN doc_id % 2 = 1 THEN '#' ELSE '' END || 'Chương ' || doc_id AS header FROM documents",
    "text_fingerprints": "SELECT doc_id, sha256(text) AS sha, length(text) AS chars FROM documents",
    "slugs": "SELECT doc_id, left(trim(" + _gsub(_gsub(_gsub("' ._a/b:' || replace(text, chr(10), ' ')", r"[<>:\"/\\\\|?*\x00-\x1F]".replace("\\\\", "\\"), "_"), r"[ \t\n\r]+", "_"), "_+", "_") + ", '._ '), 120) AS slug FROM documents",
    "natural_sort": "SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY doc_id % 120, doc_id) AS ord FROM (SELECT source, doc_id, 'Chap ' || (doc_id % 120) || ' part' || doc_id || '.TXT' AS name FROM documents)",
}
