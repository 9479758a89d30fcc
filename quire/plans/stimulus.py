"""Inputs made from the documents table: the same expression, in the common dialect, for Spark and DuckDB.

documents has no headers, double spaces, escapes or brackets, so operators on it as it is
would match any oracle. These expressions put them in, by doc_id, on all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: documents with what cleaning looks for.
DIRTY = """CASE doc_id % 10
 WHEN 0 THEN replace(replace(text, ' the ', '  the   '), '. ', ' . ')
 WHEN 1 THEN replace(replace(text, ', ', ' ,  ('), '. ', ' ). ')
 WHEN 2 THEN replace(text, '. ', '. ' || chr(10) || chr(10) || chr(10) || chr(10))
 WHEN 3 THEN replace(replace(text, '. ', '.' || chr(92) || 'n'), ', ', ',' || chr(92) || 'r' || chr(92) || 'n')
 WHEN 4 THEN replace(text, ', ', ', "x“y”z„q‟w＂ ')
 WHEN 5 THEN replace(replace(text, ', ', ',​ '), '. ', '.' || chr(7) || ' ')
 WHEN 6 THEN replace(replace(text, '. ', '.<br/> <b>x</b> '), ', ', ', <!-- c --> ')
 WHEN 7 THEN replace(replace(text, '. ', ' [a] 【b】 ((c)) '), ', ', ' «d» ')
 WHEN 8 THEN replace(replace(text, '. ', ' &amp; 5 &lt; 6 '), ', ', ' & 7% + 8 ')
 ELSE replace(text, '.', '') END""".replace("\\u200b", "​")

#: documents, each under a header of one of several kinds, or a line that is none.
HEADED = """CASE doc_id % 19
 WHEN 0 THEN 'Chương ' || CAST(doc_id % 40 + 1 AS STRING) || ': Mở đầu ' || CAST(doc_id % 3 AS STRING)
 WHEN 1 THEN 'HỒI ' || CAST(doc_id % 40 + 1 AS STRING)
 WHEN 2 THEN 'Chapter ' || CAST(doc_id % 40 + 1 AS STRING) || ' - Start'
 WHEN 3 THEN '第' || CAST(doc_id % 40 + 1 AS STRING) || '章'
 WHEN 4 THEN '## Phần ' || CAST(doc_id % 40 + 1 AS STRING) || '. '
 WHEN 5 THEN '【00:' || CAST(10 + doc_id % 50 AS STRING) || '】'
 WHEN 6 THEN 'volume ' || CAST(doc_id % 40 + 1 AS STRING) || ', Last Words'
 WHEN 7 THEN 'Tập' || CAST(doc_id % 40 + 1 AS STRING) || 'Đêm ấy trời mưa'
 WHEN 8 THEN 'Chương ' || CAST(doc_id % 40 + 1 AS STRING) || ' Mở đầu'
 WHEN 9 THEN '第' || CAST(doc_id % 40 + 1 AS STRING) || '章 标题'
 WHEN 10 THEN '[第' || CAST(doc_id % 40 + 1 AS STRING) || '章] 流民不可怕'
 WHEN 11 THEN 'Chương ' || CAST(doc_id % 40 + 1 AS STRING) || ': Chạy trốnNàng vội vã đi'
 WHEN 12 THEN '第' || CAST(doc_id % 40 + 1 AS STRING) || '章: Đêm ấy rất dài'
 WHEN 13 THEN '第' || CAST(doc_id % 10 AS STRING) || '章ab'
 WHEN 14 THEN '【第' || CAST(doc_id % 40 + 1 AS STRING) || '章】' || chr(13)
 WHEN 15 THEN 'Chương ' || CAST(doc_id % 40 + 1 AS STRING) || chr(10) || ' ' || chr(10) || 'Chương thứ ' || CAST(doc_id % 40 + 1 AS STRING)
 WHEN 16 THEN '第' || CAST(doc_id % 40 + 1 AS STRING) || '章：“标题”'
 WHEN 17 THEN 'Chapter' || CAST(doc_id % 40 + 1 AS STRING) || ': “Night' || chr(92) || 'nFall”' || chr(10) || 'he said  “no” ,' || chr(92) || 'nand left'
 ELSE 'Chương trình ' || CAST(doc_id % 40 + 1 AS STRING) END || chr(10) || text"""

#: A volume: the documents of a source within a range of ids, so that no text grows with the table.
VOLUME = "source || '/' || CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS STRING)"

DIRTY_SQL = f"dirty AS (SELECT doc_id, source, lang, {DIRTY} AS text FROM documents)"
NOVELS_SQL = f"novels AS (SELECT source, string_agg(piece, chr(10) ORDER BY doc_id) AS text FROM (SELECT {VOLUME} AS source, doc_id, {HEADED} AS piece FROM documents) GROUP BY source)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "source", "lang", F.expr(DIRTY).alias("text"))


def novels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, text: the headed documents of each volume (at most 1,000 ids of a source), in order, as one text."""
    pieces = documents(spark, sf_dir).select(F.expr(VOLUME).alias("source"), F.struct("doc_id", F.expr(HEADED).alias("piece")).alias("p"))
    return pieces.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "\n").alias("text"))
