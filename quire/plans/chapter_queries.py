"""Queries over chapters and headings, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.operators import detect
from quire.plans.stimulus import NOVELS_SQL, novels
from quire.plans.text_queries import ENDED_LINES, LACKS_ENDING, SPACED
from quire.session import persist_table

# The rules once more, in DuckDB's dialect and for ASCII digits only.
_DECO = r"[ \t\n\r\f\x0B\x{A0}\x{3000}>»\-–—*#【\[（\(★\]】）\)〔〕《》〈〉「」『』]"
_VI_WORDS = "Chương hồi|Chương|Chuong|Hồi|Hoi|Quyển|Quyen|Phần|Phan|Tập|Tap"
_EN_WORDS = r"Chapter|Chap\.?|Book|Part|Volume|Vol\.?|Episode|Ep\.?"
_UNIT = "[章節节回卷話话囘集]"
_NUM = "([0-9][0-9,，]*)"
_TITLE = r"(?:\s*[.:：\-–—、,，]\s*(.*))?$"
_VI, _EN = (rf"(?i)^{_DECO}*({w})[\s.,:：\-–—]*{_NUM}{_TITLE}" for w in (_VI_WORDS, _EN_WORDS))
_ZH = rf"^{_DECO}*(第)\s*{_NUM}\s*{_UNIT}(?:\s*[.:：\-–—、,，]\s*(.*?))?$"
_VI_HEAD, _EN_HEAD = (rf"(?i)^{_DECO}*(?:{w})[\s.,:：\-–—]*{_NUM}" for w in (_VI_WORDS, _EN_WORDS))
_ZH_HEAD = rf"^{_DECO}*第\s*{_NUM}\s*{_UNIT}"
_SPACES = r"[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{_SPACES}+|{_SPACES}+\\z', '', 'g')"


def _han_only(x: str) -> str:
    return rf"(regexp_matches({x}, '[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]') AND NOT regexp_matches({x}, '[A-Za-zÀ-ỹ]'))"


_CLOSE = r"[\]】）)〕》〉」』〗]"

LINES_SQL = rf"""{NOVELS_SQL},
lines AS (SELECT source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_index FROM novels),
clocked AS (SELECT *, {_strip("line")} AS body, length(line) <= 40 AND regexp_matches(regexp_replace(line, '^[ \t【】\[\]\-–—:!?.,;()]+|[ \t【】\[\]\-–—:!?.,;()]+$', '', 'g'), '^[0-9]{{1,3}}:[0-9]{{2}}(:[0-9]{{2}})?(\s*[—–-]\s*\S.*)?$') AS clock FROM lines),
kinds AS (SELECT *, CASE WHEN clock OR length(body) > 200 THEN NULL WHEN regexp_matches(body, '{_VI}') THEN 'vi' WHEN regexp_matches(body, '{_EN}') THEN 'en' WHEN regexp_matches(body, '{_ZH}') THEN 'zh' END AS whole,
  CASE WHEN clock OR length(body) < 4 THEN NULL WHEN regexp_matches(body, '{_VI_HEAD}') THEN 'vi' WHEN regexp_matches(body, '{_EN_HEAD}') THEN 'en' WHEN regexp_matches(body, '{_ZH_HEAD}') THEN 'zh' END AS part FROM clocked),
parts AS (SELECT *, CASE coalesce(whole, part) WHEN 'vi' THEN CASE WHEN whole IS NULL THEN regexp_extract(body, '{_VI_HEAD}', 1) ELSE regexp_extract(body, '{_VI}', 2) END
    WHEN 'en' THEN CASE WHEN whole IS NULL THEN regexp_extract(body, '{_EN_HEAD}', 1) ELSE regexp_extract(body, '{_EN}', 2) END
    WHEN 'zh' THEN CASE WHEN whole IS NULL THEN regexp_extract(body, '{_ZH_HEAD}', 1) ELSE regexp_extract(body, '{_ZH}', 2) END END AS token,
  CASE whole WHEN 'vi' THEN regexp_extract(body, '{_VI}', 3) WHEN 'en' THEN regexp_extract(body, '{_EN}', 3) WHEN 'zh' THEN regexp_extract(body, '{_ZH}', 3) END AS after,
  CASE part WHEN 'vi' THEN regexp_extract(body, '{_VI_HEAD}') WHEN 'en' THEN regexp_extract(body, '{_EN_HEAD}') WHEN 'zh' THEN regexp_extract(body, '{_ZH_HEAD}') END AS head FROM kinds),
rests AS (SELECT *, {_strip(rf"regexp_replace({_strip('after')}, '^[:：\-–—]+|[:：\-–—]+$', '', 'g')")} AS name, {_strip("substring(body, length(head) + 1)")} AS rest FROM parts),
bits AS (SELECT *, regexp_extract(name, '(?s)^(.*?[\p{{L}}\p{{N}}])([A-Z\x{{4E00}}-\x{{9FFF}}].*)$', 1) AS n1, regexp_extract(name, '(?s)^(.*?[\p{{L}}\p{{N}}])([A-Z\x{{4E00}}-\x{{9FFF}}].*)$', 2) AS n2,
  regexp_replace(regexp_extract(rest, '^(?:{_CLOSE}\s*)*'), '\s', '', 'g') AS closing, {_strip(rf"regexp_replace(rest, '^(?:{_CLOSE}\s*)*[:：\-–—、,，]*', '')")} AS content FROM rests),
splits AS (SELECT *, length(trim(n1)) >= 2 AND length(trim(n2)) >= 6 AND contains(trim(n2), ' ') AS split FROM bits),
heads AS (SELECT source, line_index, line, body,
  CASE WHEN whole IS NOT NULL OR part = 'zh' OR length(rest) > 0 THEN coalesce(whole, part) END AS language, CAST(replace(replace(token, ',', ''), '，', '') AS BIGINT) AS number,
  CASE WHEN whole = 'zh' THEN CASE WHEN {_han_only("name")} THEN name ELSE '' END WHEN whole IS NOT NULL THEN CASE WHEN split THEN trim(n1) ELSE name END WHEN part = 'zh' AND {_han_only("content")} THEN content ELSE '' END AS title,
  CASE WHEN whole = 'zh' THEN CASE WHEN {_han_only("name")} THEN '' ELSE name END WHEN whole IS NOT NULL THEN CASE WHEN split THEN trim(n2) ELSE '' END WHEN part = 'zh' THEN CASE WHEN {_han_only("content")} THEN '' ELSE content END ELSE rest END AS goes_on,
  CASE WHEN whole = 'zh' THEN CASE WHEN name = '' THEN body ELSE regexp_replace(left(body, length(body) - length(after)), '\s*[:：\-–—、,，]*\s*$', '') END WHEN whole IS NOT NULL THEN CASE WHEN split THEN trim(left(body, length(body) - length(trim(n2)))) ELSE body END WHEN part = 'zh' THEN trim(head) || closing ELSE trim(head) END AS header_line,
  CASE WHEN whole = 'zh' THEN name <> '' AND NOT {_han_only("name")} WHEN whole IS NOT NULL THEN split ELSE true END AS glued
  FROM splits)"""
CHAPTERS_SQL = f"""{LINES_SQL},
numbered AS (SELECT *, count(language) OVER (PARTITION BY source ORDER BY line_index) AS section FROM heads),
sections AS (SELECT source, section, max(CASE WHEN language IS NOT NULL THEN number END) AS number, max(CASE WHEN language IS NOT NULL THEN header_line END) AS header_line,
  max(CASE WHEN language IS NOT NULL THEN title END) AS title, max(language) AS language, bool_or(language IS NOT NULL AND glued) AS glued, min(line_index) AS source_line,
  coalesce(string_agg(CASE WHEN language IS NULL THEN line ELSE nullif(goes_on, '') END, chr(10) ORDER BY line_index), '') AS text
  FROM numbered GROUP BY source, section),
chapters AS (SELECT * EXCLUDE (text), CASE WHEN section = 0 THEN text ELSE trim(text, chr(10)) END AS text, length(CASE WHEN section = 0 THEN text ELSE trim(text, chr(10)) END) AS chars FROM sections)"""
_RANK = "CASE language WHEN 'vi' THEN 3 WHEN 'mixed' THEN 2 WHEN 'en' THEN 1 WHEN 'zh' THEN -1 ELSE 0 END DESC, (length(trim(coalesce(title, ''))) > 0) DESC, chars DESC, source_line"


def _ranked(table: str) -> str:
    return f"ranked AS (SELECT *, row_number() OVER (PARTITION BY source, number ORDER BY {_RANK}) AS rank, first_value(language) OVER same AS best_language, first_value(chars) OVER same AS best_chars, first_value(length(trim(coalesce(title, ''))) > 0) OVER same AS best_titled FROM {table} WHERE section > 0 WINDOW same AS (PARTITION BY source, number ORDER BY {_RANK}))"


DEDUPED_SQL = f"{CHAPTERS_SQL}, {_ranked('chapters')}"
_MARKERS = "chương|chuong|hồi|hoi|quyển|quyen|phần|phan|tập|tap|chapter|chap|book|part|volume"
_QUOTES = "\"“”„‟＂"
_BARE = rf"lower(regexp_replace({_strip('x')}, '^[:：\-–—]+|[:：\-–—]+$', '', 'g'))"
_NORM_CTES = rf"""
opened AS (SELECT *, list_position(list_transform(string_split(text, chr(10)), lambda x: length({_strip("x")}) > 0 AND NOT (regexp_matches({_BARE}, '^(?:{_MARKERS})') AND contains(x, CAST(number AS VARCHAR)))), true) AS first FROM chapters WHERE section > 0),
begun AS (SELECT * EXCLUDE (text), chars AS raw_chars, coalesce(first, 1) > 1 AS repeated, CASE WHEN coalesce(first, 1) > 1 THEN array_to_string(string_split(text, chr(10))[first:], chr(10)) ELSE text END AS text FROM opened),
restored AS (SELECT * EXCLUDE (text), len(regexp_extract_all(text, '\\r\\n|\\n|\\r')) AS restored, regexp_replace(text, '\\r\\n|\\n|\\r', chr(10), 'g') AS text FROM begun),
spaced AS (SELECT * EXCLUDE (text), {SPACED} AS text FROM restored),
quoted AS (SELECT * EXCLUDE (text, title), language = 'zh' AND title <> '' AS dropped, length(text || CASE WHEN language = 'zh' THEN '' ELSE title END) - length(translate(text || CASE WHEN language = 'zh' THEN '' ELSE title END, '{_QUOTES}', '')) AS quotes, CASE WHEN language = 'zh' THEN '' ELSE translate(title, '{_QUOTES}', repeat(chr(39), 6)) END AS title, translate(text, '{_QUOTES}', repeat(chr(39), 6)) AS text FROM spaced),
lined AS (SELECT *, {ENDED_LINES} AS ls FROM quoted),
cleaned AS (SELECT * EXCLUDE (text, chars, ls), len(list_filter(ls, lambda l: {LACKS_ENDING})) AS added, {_strip("array_to_string(list_transform(ls, lambda l: CASE WHEN " + LACKS_ENDING + " THEN l.trimmed || '.' ELSE l.x END), chr(10))")} AS text FROM lined),
canonical AS (SELECT *, length(text) AS chars FROM cleaned)"""
NORMAL_SQL = f"{CHAPTERS_SQL}, {_NORM_CTES}, {_ranked('canonical')}"
_PHYSICAL = r"[^\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]|\z)"
SPANS_SQL = rf"""{NOVELS_SQL},
pieces AS (SELECT source, length(text) AS total, unnest(regexp_extract_all(text, '{_PHYSICAL}')) AS physical, generate_subscripts(regexp_extract_all(text, '{_PHYSICAL}'), 1) AS nr FROM novels),
placed AS (SELECT *, rtrim(physical, chr(13) || chr(10)) AS line, coalesce(sum(length(physical)) OVER (PARTITION BY source ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pieces WHERE length(physical) > 0),
bare AS (SELECT *, {_strip("line")} AS body, regexp_matches(line, '^[ 【]*[0-9]{{1,3}}:[0-9]{{2}}[】 ]*$') AS clock FROM placed),
tokens AS (SELECT *, CASE WHEN clock THEN '' WHEN regexp_matches(body, '{_VI}') THEN regexp_extract(body, '{_VI}', 2) WHEN regexp_matches(body, '{_VI_HEAD}([\s:：.\-–—]|$)') THEN regexp_extract(body, '{_VI_HEAD}', 1)
  WHEN regexp_matches(body, '{_EN}') THEN regexp_extract(body, '{_EN}', 2) WHEN regexp_matches(body, '{_EN_HEAD}([\s:：.\-–—]|$)') THEN regexp_extract(body, '{_EN_HEAD}', 1) WHEN regexp_matches(body, '{_ZH}') THEN regexp_extract(body, '{_ZH}', 2) ELSE '' END AS token FROM bare),
spans AS (SELECT source, CAST(replace(replace(token, ',', ''), '，', '') AS BIGINT) AS number, line AS heading, CAST(start AS BIGINT) AS start, CAST(start + length(physical) AS BIGINT) AS body_start,
  CAST(coalesce(lead(start) OVER (PARTITION BY source ORDER BY nr), total) AS BIGINT) AS "end", nr AS line FROM tokens WHERE token <> '')"""
_COUNTED = """ordered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY start) AS rn FROM spans),
counted AS (SELECT source, (rn - 1) // 7 + 1 AS ord, CASE WHEN count(*) = 1 THEN CAST(min(number) AS VARCHAR) ELSE arg_min(number, start) || '-' || arg_max(number, start) END AS range_label, CASE WHEN (rn - 1) // 7 = 0 THEN 0 ELSE min(start) END AS start, max("end") AS "end", count(*) AS chapters FROM ordered GROUP BY source, (rn - 1) // 7)"""


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.chapters(novels(spark, sf_dir))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.heading_spans(novels(spark, sf_dir))


def detect_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.headers(novels(spark, sf_dir)).select("source", F.col("line_index").cast("long").alias("line_index"), "line", "number", "title", "language", "header", F.col("body").alias("goes_on"))


def detect_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chapters(spark, sf_dir).select("source", "section", "number", "header_line", "title", "language", F.col("source_line").cast("long").alias("source_line"), F.sha2("text", 256).alias("text_sha256"), F.col("chars").cast("long").alias("chars"), "glued")


def glued_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    glued = detect.headers(novels(spark, sf_dir)).filter("glued and body <> ''")
    return glued.select("source", F.col("line_index").cast("long").alias("line_index"), F.col("header").alias("head"), "number", "body")


def clock_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.lines(novels(spark, sf_dir)).filter(detect.is_clock(F.col("line"))).groupBy("source").agg(F.count(F.lit(1)).alias("clock_lines"))


def dedupe_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = detect.dedupe(_chapters(spark, sf_dir).filter("section > 0"))
    return kept.select("source", "number", "language", "title", F.col("chars").cast("long").alias("chars"), F.col("source_line").cast("long").alias("source_line"))


def dedupe_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = detect.rank_variants(_chapters(spark, sf_dir).filter("section > 0")).filter("rank > 1")
    return ranked.groupBy("reason", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


def chapter_dedupe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = detect.dedupe(_chapters(spark, sf_dir).filter("section > 0"))
    return kept.groupBy("language").agg(F.count(F.lit(1)).alias("chapters"), F.sum("chars").alias("total_chars"), F.min("chars").cast("long").alias("min_chars"), F.max("chars").cast("long").alias("max_chars"))


def normalize_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.normalize(novels(spark, sf_dir)).select("source", "number", "header", F.col("chars").cast("long").alias("chars"), F.col("text_loss").cast("long").alias("text_loss"), F.sha2("text", 256).alias("text_sha256"))


def normalize_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.normalize_report(novels(spark, sf_dir))


def text_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that lost 50 characters or more in normalizing."""
    lost = detect.loss_diagnostics(detect.normalize(novels(spark, sf_dir)))
    return lost.select("source", "number", F.col("text_loss").cast("long").alias("text_loss"), "severity")


def renumber_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical chapters numbered from 101 on."""
    return detect.renumber(detect.normalize(novels(spark, sf_dir)), first=101).select("source", "number", "header", "changed")


def missing_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.first_missing(detect.sequence_gaps(detect.headers(novels(spark, sf_dir))), 1000)


def _far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the volumes, of which some have one number far off."""
    far = F.when((F.col("line_index") == 0) & F.col("source").rlike("[258]/"), F.lit(99_999_999_999)).otherwise(F.col("number"))
    return detect.headers(novels(spark, sf_dir)).withColumn("number", far).withColumnRenamed("line_index", "source_line")


def sequence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing numbers and neighbours out of order, with one number of many digits among the others."""
    told = detect.sequence_report(_far(spark, sf_dir))
    first = F.array_join(F.transform("first_breaks", lambda b: F.concat_ws(":", b["source_line"], b["previous"], b["number"], b["kind"])), " ")
    return told.select("source", "missing", F.array_join(F.col("first_missing").cast("array<string>"), ",").alias("first_missing"), "breaks", first.alias("first_breaks"))


def heading_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = detect.headers(novels(spark, sf_dir)).withColumnRenamed("line_index", "source_line")
    return detect.order_breaks(heads).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


def scan_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


def group_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.group_by_count(_spans(spark, sf_dir), 7)


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings with rising numbers and gaps between them: number k for the k-th heading, of every seventh none, but where a group of ten begins; in every third volume not even there."""
    texts = novels(spark, sf_dir)
    spans = detect.heading_spans(texts)
    nth = F.row_number().over(W.partitionBy("source").orderBy("start"))
    drop = (F.col("nth") % 7 == 0) & ((F.col("nth") % 10 != 1) | F.col("source").rlike("[147]/"))
    return spans.withColumn("nth", nth).filter(~drop).withColumn("number", F.col("nth").cast("long")).drop("nth")


def group_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.plan_groups(_sparse(spark, sf_dir), 10, "numeric")


def grouping_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = detect.analyze_grouping(_spans(spark, sf_dir), 10)
    return told.withColumn("missing_starts", F.array_join(detect.listed_starts(F.col("missing_starts"), 10).cast("array<string>"), ","))


def sparse_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = detect.analyze_grouping(_sparse(spark, sf_dir), 10)
    return told.select("source", "expected_count", "headings", "needs_numbers", F.array_join(detect.listed_starts(F.col("missing_starts"), 10).cast("array<string>"), ",").alias("missing_starts"), "refusal")


def group_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = novels(spark, sf_dir)
    groups = detect.group_identity(detect.group_by_count(detect.heading_spans(texts), 7), texts, 7)
    return detect.group_texts(groups, texts).select("source", "ord", "group_id", "text_sha256", F.length("slice").cast("long").alias("chars"))


def group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.group_names(detect.group_by_count(_spans(spark, sf_dir), 7)).select("source", "ord", "name")


def exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the groups by count, some of which lack a group in the middle, whether they cover the text."""
    texts = novels(spark, sf_dir)
    groups = detect.group_by_count(detect.heading_spans(texts), 7)
    return detect.exact_cover(groups.filter("NOT (ord = 2 AND source LIKE '%3/%')"), texts)


def numeric_starts_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts first, first + 10, ... up to the largest number that have no heading."""
    there = persist_table(_spans(spark, sf_dir).select("source", "number").distinct(), "numbers")  # read twice, found once
    ends = there.groupBy("source").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    starts = ends.select("source", F.explode(F.sequence("low", "high", F.lit(10).cast("long"))).alias("number"))
    return starts.join(there, ["source", "number"], "left_anti")


def expected_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last number minus first, in source order, plus one."""
    return _spans(spark, sf_dir).groupBy("source").agg((F.max_by("number", "start") - F.min_by("number", "start") + 1).alias("expected"), F.count(F.lit(1)).alias("found"))


def render_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of a source as one text: header, blank line, body, two blank lines between; and its digest."""
    from quire.sources.sinks import render

    out = render(detect.normalize(novels(spark, sf_dir)))
    return out.select("source", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


def line_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: lines by the last header at or before them."""
    told = detect.told_lines(novels(spark, sf_dir))
    last = F.last("h", ignorenulls=True).over(W.partitionBy("source").orderBy("line_index").rowsBetween(W.unboundedPreceding, 0))
    return told.withColumn("n", last["number"]).groupBy("source", "n").agg(F.count(F.lit(1)).alias("line_count"), F.sum(F.length("line")).alias("chars"))


QUERIES = {f.__name__: f for f in (detect_headers, detect_chapters, glued_headers, clock_guard, dedupe_chapters, dedupe_reasons, chapter_dedupe_stats, normalize_chapters, normalize_report, text_loss, renumber_chapters, missing_chapters, sequence_report, heading_diagnostics, scan_headings, group_by_count, group_by_number, grouping_analysis, sparse_analysis, group_identity, group_names, exact_cover, numeric_starts_missing, expected_count, render_chapters, line_header)}

_HEADER = "CASE WHEN trim(title) = '' THEN 'Chương ' || number ELSE 'Chương ' || number || ': ' || trim(title) END"
HEADER_SQL = _HEADER
_ANALYSIS = """steps AS (SELECT *, number - lag(number) OVER (PARTITION BY source ORDER BY start) AS step FROM {0}),
totals AS (SELECT source, arg_min(number, start) AS first_number, arg_max(number, start) AS last_number, count(*) AS headings, count(*) FILTER (step = 0) AS repeats, count(*) FILTER (step < 0) AS resets, count(*) FILTER (step > 1) AS gaps, list(number) AS numbers FROM steps GROUP BY source),
needs AS (SELECT *, last_number - first_number + 1 AS expected_count, gaps > 0 AND last_number - first_number + 1 > 0 AND headings < last_number - first_number + 1 AS needs_numbers FROM totals),
missing AS (SELECT * EXCLUDE (numbers), CASE WHEN needs_numbers THEN list_filter(range(first_number, last_number + 1, 10), lambda n: NOT list_contains(numbers, n)) END AS missing FROM needs),
analysis AS (SELECT * EXCLUDE (missing), array_to_string(missing, ',') AS missing_starts, CASE WHEN NOT needs_numbers THEN 'not_needed' WHEN repeats > 0 OR resets > 0 THEN 'ambiguous' WHEN len(missing) > 0 THEN 'missing_starts' END AS refusal FROM missing)"""
_SPARSE = """sparse AS (SELECT * EXCLUDE (number, nth), nth AS number FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY start) AS nth FROM spans) WHERE NOT (nth % 7 = 0 AND (nth % 10 <> 1 OR regexp_matches(source, '[147]/'))))"""
_REASON = "CASE WHEN language = 'zh' AND best_language IN ('vi', 'mixed', 'en') THEN 'language' WHEN best_titled AND NOT (length(trim(coalesce(title, ''))) > 0) THEN 'no_title' WHEN chars < best_chars THEN 'shorter' WHEN chars = best_chars THEN 'same' ELSE 'lower_rank' END"
ORACLES = {
    "detect_headers": f"WITH {LINES_SQL} SELECT source, line_index, line, number, title, language, header_line AS header, goes_on FROM heads WHERE language IS NOT NULL",
    "detect_chapters": f"WITH {CHAPTERS_SQL} SELECT source, section, number, header_line, title, language, source_line, sha256(text) AS text_sha256, chars, coalesce(glued, false) AS glued FROM chapters",
    "glued_headers": f"WITH {LINES_SQL} SELECT source, line_index, header_line AS head, number, goes_on AS body FROM heads WHERE language IS NOT NULL AND glued AND goes_on <> ''",
    "clock_guard": f"WITH {LINES_SQL} SELECT source, count(*) AS clock_lines FROM clocked WHERE clock GROUP BY source",
    "dedupe_chapters": f"WITH {DEDUPED_SQL} SELECT source, number, language, title, chars, source_line FROM ranked WHERE rank = 1",
    "dedupe_reasons": f"WITH {DEDUPED_SQL} SELECT {_REASON} AS reason, language, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM ranked WHERE rank > 1 GROUP BY 1, 2",
    "chapter_dedupe_stats": f"WITH {DEDUPED_SQL} SELECT language, count(*) AS chapters, CAST(sum(chars) AS BIGINT) AS total_chars, min(chars) AS min_chars, max(chars) AS max_chars FROM ranked WHERE rank = 1 GROUP BY language",
    "normalize_chapters": f"WITH {NORMAL_SQL} SELECT source, number, {_HEADER} AS header, chars, greatest(raw_chars - chars, 0) AS text_loss, sha256(text) AS text_sha256 FROM ranked WHERE rank = 1",
    "text_loss": f"WITH {NORMAL_SQL} SELECT source, number, raw_chars - chars AS text_loss, CASE WHEN raw_chars - chars >= 100 THEN 'warning' ELSE 'info' END AS severity FROM ranked WHERE rank = 1 AND raw_chars - chars >= 50",
    "renumber_chapters": f"WITH {NORMAL_SQL}, renewed AS (SELECT source, number AS old, title, 100 + row_number() OVER (PARTITION BY source ORDER BY source_line) AS number FROM ranked WHERE rank = 1) SELECT source, number, {_HEADER} AS header, old <> number AS changed FROM renewed",
    "normalize_report": f"""WITH {NORMAL_SQL}, pre AS (SELECT source, sum(length(text) - length(translate(text, '{_QUOTES}', ''))) AS n FROM chapters WHERE section = 0 GROUP BY source)
 SELECT r.source, count(*) AS found, count(*) FILTER (rank = 1) AS chapters, count(*) FILTER (glued) AS glued_splits, count(*) FILTER (repeated) AS header_artifacts_removed, CAST(sum(restored) AS BIGINT) AS restored_newlines, CAST(sum(added) AS BIGINT) AS periods_added, count(*) FILTER (dropped) AS chinese_titles_removed,
 CAST(sum(CASE WHEN rank > 1 THEN chars ELSE 0 END) AS BIGINT) AS discarded_chars, CAST(sum(CASE WHEN rank = 1 THEN greatest(raw_chars - chars, 0) ELSE 0 END) AS BIGINT) AS text_loss, CAST(sum(quotes) + coalesce(max(pre.n), 0) AS BIGINT) AS double_quotes_normalized FROM ranked r LEFT JOIN pre ON pre.source = r.source GROUP BY r.source""",
    "missing_chapters": f"WITH {LINES_SQL}, ends AS (SELECT source, min(number) AS low, max(number) AS high FROM heads WHERE language IS NOT NULL GROUP BY source) SELECT source, n AS number FROM (SELECT source, unnest(generate_series(low, high)) AS n FROM ends) e WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE language IS NOT NULL AND h.source = e.source AND h.number = e.n)",
    "heading_diagnostics": f"WITH {LINES_SQL}, pairs AS (SELECT source, number, lag(number) OVER (PARTITION BY source ORDER BY line_index) AS previous FROM heads WHERE language IS NOT NULL) SELECT source, CASE WHEN number = previous THEN 'repeat' WHEN number < previous THEN 'reset' ELSE 'gap' END AS kind, count(*) AS n FROM pairs WHERE previous IS NOT NULL AND number <> previous + 1 GROUP BY 1, 2",
    "scan_headings": f"WITH {SPANS_SQL} SELECT * FROM spans",
    "group_by_count": f"WITH {SPANS_SQL}, {_COUNTED} SELECT source, ord, 'Chương ' || range_label AS label, range_label, start, \"end\", chapters FROM counted",
    "grouping_analysis": f"WITH {SPANS_SQL}, {_ANALYSIS.format('spans')} SELECT * FROM analysis",
    "sparse_analysis": f"WITH {SPANS_SQL}, {_SPARSE}, {_ANALYSIS.format('sparse')} SELECT source, expected_count, headings, needs_numbers, missing_starts, refusal FROM analysis",
    "group_by_number": f"""WITH {SPANS_SQL}, {_SPARSE}, {_ANALYSIS.format('sparse')}, g AS (SELECT s.*, a.first_number, a.last_number, (s.number - a.first_number) // 10 AS k FROM sparse s JOIN analysis a ON a.source = s.source WHERE a.refusal IS NULL), r AS (SELECT source, k + 1 AS ord, CASE WHEN first_number + k * 10 = least(first_number + k * 10 + 9, last_number) THEN CAST(last_number AS VARCHAR) ELSE (first_number + k * 10) || '-' || least(first_number + k * 10 + 9, last_number) END AS range_label, CASE WHEN k = 0 THEN 0 ELSE min(start) END AS start, max("end") AS "end", count(*) AS chapters FROM g GROUP BY source, k, first_number, last_number) SELECT *, 'Chương ' || range_label AS label FROM r""",
    "group_identity": f"""WITH {SPANS_SQL}, {_COUNTED} SELECT c.source, ord, sha256(substring(text, CAST(start AS INT) + 1, CAST("end" - start AS INT))) AS text_sha256, "end" - start AS chars, left(sha256(concat(sha256(text), chr(0), c.source, chr(0), '7', chr(0), ord, chr(0), start, chr(0), "end")), 24) AS group_id FROM counted c JOIN novels n ON c.source = n.source""",
    "group_names": f"""WITH {SPANS_SQL}, {_COUNTED} SELECT source, ord, replace(source, '/', '_') || '_' || range_label || CASE WHEN row_number() OVER (PARTITION BY source, range_label ORDER BY ord) > 1 THEN '_group_' || lpad(CAST(ord AS VARCHAR), 3, '0') ELSE '' END AS name FROM counted""",
    "exact_cover": f"WITH {SPANS_SQL}, {_COUNTED} SELECT n.source, coalesce(max(ord) IS NOT NULL AND NOT (n.source LIKE '%3/%' AND max(ord) >= 2), false) AS covered FROM novels n LEFT JOIN counted c ON c.source = n.source GROUP BY n.source",
    "sequence_report": f"""WITH {LINES_SQL}, h AS (SELECT source, line_index, CASE WHEN line_index = 0 AND regexp_matches(source, '[258]/') THEN 99999999999 ELSE number END AS number FROM heads WHERE language IS NOT NULL),
 s AS (SELECT source, number, lead(number) OVER (PARTITION BY source ORDER BY number) AS next FROM (SELECT DISTINCT source, number FROM h)), g AS (SELECT * FROM s WHERE next > number + 1),
 f AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY n) AS r FROM (SELECT source, unnest(range(number + 1, least(next, number + 41))) AS n FROM g)),
 m AS (SELECT source, CAST(sum(next - number - 1) AS BIGINT) AS missing FROM g GROUP BY source), l AS (SELECT source, string_agg(n, ',' ORDER BY n) AS first_missing FROM f WHERE r <= 40 GROUP BY source),
 b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_index) AS r FROM (SELECT source, line_index, number, lag(number) OVER (PARTITION BY source ORDER BY line_index) AS previous FROM h) WHERE number <> previous + 1),
 k AS (SELECT source, count(*) AS breaks, string_agg(line_index || ':' || previous || ':' || number || ':' || CASE WHEN number = previous THEN 'repeat' WHEN number < previous THEN 'reset' ELSE 'gap' END, ' ' ORDER BY line_index) FILTER (r <= 10) AS first_breaks FROM b GROUP BY source)
 SELECT coalesce(m.source, k.source) AS source, coalesce(missing, 0) AS missing, coalesce(first_missing, '') AS first_missing, coalesce(breaks, 0) AS breaks, first_breaks FROM m JOIN l ON l.source = m.source FULL JOIN k ON k.source = m.source""",
    "numeric_starts_missing": f"WITH {SPANS_SQL}, ends AS (SELECT source, min(number) AS low, max(number) AS high FROM spans GROUP BY source) SELECT source, n AS number FROM (SELECT source, unnest(generate_series(low, high, 10)) AS n FROM ends) e WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.source = e.source AND s.number = e.n)",
    "expected_count": f"WITH {SPANS_SQL} SELECT source, arg_max(number, start) - arg_min(number, start) + 1 AS expected, count(*) AS found FROM spans GROUP BY source",
    "render_chapters": f"WITH {NORMAL_SQL}, pieces AS (SELECT source, number, source_line, {_HEADER} || chr(10) || chr(10) || CASE WHEN text = '' THEN '' ELSE text || repeat(chr(10), 3) END AS part FROM ranked WHERE rank = 1) SELECT source, length(t) AS chars, sha256(t) AS text_sha256 FROM (SELECT source, {_strip("string_agg(part, '' ORDER BY number, source_line)")} || chr(10) AS t FROM pieces GROUP BY source)",
    "line_header": f"WITH {LINES_SQL}, seen AS (SELECT source, line, last_value(CASE WHEN language IS NOT NULL THEN number END IGNORE NULLS) OVER (PARTITION BY source ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM heads) SELECT source, n, count(*) AS line_count, CAST(sum(length(line)) AS BIGINT) AS chars FROM seen GROUP BY source, n",
}
