"""Inputs of the registered queries, derived from the shared tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark import scratch

CLEAN = "the people know the market and the price of the book "
TIMES = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as the pages of books; a book has those of a thousand ids, so that no book grows with the table."""
    book = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string"))
    df = table(spark, sf_dir, "documents").select(book.alias("doc"), "doc_id", F.col("text").alias("text_raw"))
    return scratch.dealt(df, "doc").select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("doc_id")).alias("page_num"), "doc_id", "text_raw")


def dirty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_pages with faults, by page number."""
    t, n = F.col("text_raw"), F.col("page_num")
    lit = F.lit
    dirty = (
        F.when(n % 8 == 1, F.replace(t, lit("from"), lit("frorn"))).when(n % 8 == 2, F.replace(t, lit("fi"), lit("ﬁ")))
        .when(n % 8 == 3, F.concat(t, lit(""))).when(n % 8 == 4, F.concat(t, lit("(cid:12)")))
        .when(n % 8 == 5, F.concat(n.cast("string"), lit("\n"), t)).when(n % 8 == 6, F.concat(F.substring(t, 1, 10), lit("\n\n\n\n"), F.substr(t, lit(11))))
        .when(n % 8 == 7, F.concat(lit("“"), t, lit("” …"))).otherwise(t)
    )
    header = F.when(n % 2 == 1, F.concat(lit("Running header of "), F.col("doc"), lit("\n"))).otherwise("")
    return doc_pages(spark, sf_dir).withColumn("text_raw", F.concat(header, dirty))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an OCR candidate, in seven profiles by source, so that every decision and every reason occurs."""
    t, n, k = F.col("text_raw"), F.col("page_num"), F.regexp_extract("doc", "([0-9]+)", 1).cast("int") % 7
    lit, none = F.lit, F.lit(None).cast("string")
    good, crossed = F.concat(lit(CLEAN * TIMES), t), F.translate(t, "aeiouAEIOU", "xxxxxXXXXX")

    def pick(*by_profile: Column) -> Column:
        out = F.when(k == 0, by_profile[0])
        for i, c in enumerate(by_profile[1:], 1):
            out = out.when(k == i, c)
        return out

    text = pick(good, lit(""), F.when(n % 4 == 0, good).otherwise(crossed), F.when(n % 5 == 0, "").otherwise(t), F.when(n % 2 == 1, t).otherwise(""), lit(""), crossed)
    ocr = pick(none, good, F.when(n % 4 != 0, good), none, F.when(n % 2 == 1, F.replace(t, lit("m"), lit("rn"))).otherwise(t), lit(""), crossed)
    error = F.when((k == 3) & (n % 5 == 0), "RuntimeError: stub")
    return doc_pages(spark, sf_dir).select("doc", "page_num", text.alias("a"), ocr.alias("ocr_raw"), error.alias("ocr_error")).withColumnRenamed("a", "text_raw")


def html_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host, by a thousand ids, as the chapters of a book; numbered before anything is filtered."""
    book = F.concat(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("-"), F.floor(F.col("page_id") / 1000).cast("string"))
    return table(spark, sf_dir, "pages").select(book.alias("doc"), F.row_number().over(Window.partitionBy(book).orderBy("page_id")).alias("chapter_num"), "html")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the progress ticks of one file."""
    w = Window.partitionBy("user_id")
    o = w.orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))  # sessions run in UTC
    seconds = (micros - F.first(micros).over(o)) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.row_number().over(o).alias("tick"), F.greatest(F.lit(0.001), seconds).alias("elapsed"), F.count("*").over(w).alias("total"))


DOC_PAGES_SQL = "doc_pages AS (SELECT source || '-' || (doc_id // 1000) AS doc, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id)::INT AS page_num, doc_id, text AS text_raw FROM documents)"
DIRTY_SQL = f"""{DOC_PAGES_SQL}, dirty AS (
  SELECT doc, page_num, doc_id, CASE WHEN page_num % 2 = 1 THEN 'Running header of ' || doc || chr(10) ELSE '' END || CASE page_num % 8
    WHEN 1 THEN replace(text_raw, 'from', 'frorn') WHEN 2 THEN replace(text_raw, 'fi', chr(64257)) WHEN 3 THEN text_raw || chr(57344) || chr(59648)
    WHEN 4 THEN text_raw || '(cid:12)' WHEN 5 THEN page_num::VARCHAR || chr(10) || text_raw WHEN 6 THEN substr(text_raw, 1, 10) || repeat(chr(10), 4) || substr(text_raw, 11)
    WHEN 7 THEN chr(8220) || text_raw || chr(8221) || chr(160) || chr(8230) ELSE text_raw END AS text_raw
  FROM doc_pages)"""
_GOOD = f"repeat('{CLEAN}', {TIMES}) || text_raw"
_CROSSED = "translate(text_raw, 'aeiouAEIOU', 'xxxxxXXXXX')"
CANDIDATES_SQL = f"""{DOC_PAGES_SQL}, prof AS (SELECT *, regexp_extract(doc, '[0-9]+')::INT % 7 AS k FROM doc_pages), candidates AS (
  SELECT doc, page_num,
    CASE k WHEN 0 THEN {_GOOD} WHEN 2 THEN CASE WHEN page_num % 4 = 0 THEN {_GOOD} ELSE {_CROSSED} END WHEN 3 THEN CASE WHEN page_num % 5 = 0 THEN '' ELSE text_raw END
      WHEN 4 THEN CASE WHEN page_num % 2 = 1 THEN text_raw ELSE '' END WHEN 6 THEN {_CROSSED} ELSE '' END AS text_raw,
    CASE k WHEN 1 THEN {_GOOD} WHEN 2 THEN CASE WHEN page_num % 4 <> 0 THEN {_GOOD} END WHEN 4 THEN CASE WHEN page_num % 2 = 1 THEN replace(text_raw, 'm', 'rn') ELSE text_raw END
      WHEN 5 THEN '' WHEN 6 THEN {_CROSSED} END AS ocr_raw,
    CASE WHEN k = 3 AND page_num % 5 = 0 THEN 'RuntimeError: stub' END AS ocr_error
  FROM prof)"""
CHAPTERS_SQL = "html_chapters AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page_id)::INT AS chapter_num, html FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) || '-' || (page_id // 1000) AS doc, page_id, html FROM pages))"
TICKS_SQL = """ticks AS (SELECT user_id AS file, row_number() OVER w AS tick, greatest(0.001::DOUBLE, (epoch_us(ts) - epoch_us(first_value(ts) OVER w))::DOUBLE / 1000000.0::DOUBLE) AS elapsed,
  count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
