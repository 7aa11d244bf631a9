"""Results, QC report, OCR appendix, run summary, Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark import scratch
from leafmark.functions import text as T
from leafmark.functions.quality import grade
from leafmark.operators.arbitrate import RULES


def results(docs: DataFrame, file_col: str = "file", issues: Column | None = None) -> DataFrame:
    """What a run records of each document. One without pages keeps its issues and loses its reason."""
    none = F.array().cast("array<string>")
    found = F.col("pages_extracted") > 0
    kept = lambda c, other: F.when(found, F.col(c)).otherwise(other)
    return docs.select(
        F.col(file_col).alias("file"), F.when(found, T.slugify(F.col(file_col))).alias("out"), F.lit(False).alias("skipped_existing"),
        *[kept(c, F.lit(0)).cast("long").alias(c) for c in ("pages_extracted", "pages_skipped", "pages_via_text", "pages_via_ocr", "word_count")],
        kept("avg_score", F.lit(0.0)).alias("avg_score"), kept("warnings", none).alias("warnings"), kept("ocr_errors", none).alias("ocr_errors"),
        F.coalesce(issues, none).alias("issues") if issues is not None else none.alias("issues"), F.when(found, F.col("reason")).alias("reason"),
    )


def existing(files: DataFrame) -> DataFrame:
    """Result rows of files that were skipped as their output was there."""
    none = F.array().cast("array<string>")
    zero = [F.lit(0).cast("long").alias(c) for c in ("pages_extracted", "pages_skipped", "pages_via_text", "pages_via_ocr", "word_count")]
    return files.select("file", T.slugify(F.col("file")).alias("out"), F.lit(True).alias("skipped_existing"), *zero, F.lit(0.0).alias("avg_score"), none.alias("warnings"), none.alias("ocr_errors"), none.alias("issues"), F.lit(None).cast("string").alias("reason"))


def numbered(rows: DataFrame, by: str, out: str = "n") -> DataFrame:
    """rows with their numbers from 1 in order of a column, without bringing them into one task: they are dealt by ranges and numbered
    within these, and the sizes of the ranges before (a row for each range) move the numbers up. Rows are written first, as the bounds
    of ranges are drawn from a run of their own."""
    ranges = scratch.written(rows, "to-number").repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id())
    ranges = scratch.written(ranges, "ranges").withColumn("__range", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__size"))
    before = sizes.select("__range", F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranges.join(F.broadcast(before), "__range").withColumn(out, (F.col("__before") + F.col("__at") + 1).cast("int")).drop("__range", "__at", "__before")


def qc_rows(rows: DataFrame) -> DataFrame:
    """(n, row): the report's table, in order of the file."""
    df = numbered(rows, "file")
    s = lambda c: F.col(c).cast("string")
    errors = F.when(F.size("ocr_errors") > 0, F.concat(F.size("ocr_errors").cast("string"), F.lit(" OCR errors")))
    notes = F.filter(F.concat("warnings", F.array(F.when(F.col("reason") != "", F.col("reason")), errors)), lambda x: x.isNotNull())
    notes = F.when(F.size(notes) > 0, F.array_join(notes, "; ")).otherwise("—")
    dash = [F.lit("—")] * 6
    number = [s("pages_extracted"), s("pages_via_text"), s("pages_via_ocr"), s("pages_skipped"), T.thousands(F.col("word_count")), T.whole(F.col("avg_score"))]
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", s("n"), F.substring("file", 1, 40), *cells), F.lit(" |"))
    line = F.when(F.col("skipped_existing"), row([*dash, F.lit("⏭ exists"), F.lit("skipped")]))
    line = line.when(F.size("issues") > 0, row([*[F.lit("0")] * 6, F.lit("❌ FAILED"), F.substring(F.array_join("issues", "; "), 1, 60)]))
    return df.select("n", line.otherwise(row([*number, grade(F.col("avg_score")), notes])).alias("row"))


def ocr_appendix(rows: DataFrame, shown: int = RULES.shown_errors) -> DataFrame:
    """(file, pos, line): the first errors of each document, then how many more there are."""
    more = F.size("ocr_errors") - shown
    lines = F.concat(F.transform(F.slice("ocr_errors", 1, shown), lambda x: F.concat(F.lit("- "), x)), F.when(more > 0, F.array(F.concat(F.lit("- … and "), more.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>")))
    return rows.filter(F.size("ocr_errors") > 0).select("file", F.posexplode(lines).alias("pos", "line"))


def run_summary(rows: DataFrame) -> DataFrame:
    """good, review, poor, words: one row. Failures count as poor."""
    ok, avg = F.size("issues") == 0, F.col("avg_score")
    return rows.agg(F.count_if(ok & (avg >= 60)).alias("good"), F.count_if(ok & (avg >= 40) & (avg < 60)).alias("review"), F.count_if(~ok | (avg < 40)).alias("poor"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def log_lines(rows: DataFrame) -> DataFrame:
    """(file, line): what a run says of each document on the console, without its number."""
    s = lambda c: F.col(c).cast("string")
    avg = F.col("avg_score")
    mark = F.when(avg >= 60, "✅").when(avg >= 40, "⚠️ ").otherwise("❌")
    done = F.concat(mark, F.lit(" pages="), s("pages_extracted"), F.lit(" (text="), s("pages_via_text"), F.lit(", ocr="), s("pages_via_ocr"), F.lit(") words="), T.thousands(F.col("word_count")), F.lit(" score="), T.whole(avg))
    what = F.when(F.col("skipped_existing"), "⏭  exists").when(F.size("issues") > 0, F.concat(F.lit("❌ "), F.substring(F.array_join("issues", "; "), 1, 60))).otherwise(done)
    return rows.select("file", F.concat(F.rpad(F.substring("file", 1, 48), 48, " "), F.lit(" "), what).alias("line"))


def summary_text(summary: DataFrame, seconds: float) -> DataFrame:
    """(text) of run_summary's row and the time that the run took."""
    s = lambda c: F.col(c).cast("string")
    time = f"Done in {int(seconds // 60)}m {int(seconds % 60)}s.\n\n✓ "
    return summary.select(F.concat(F.lit(time), s("good"), F.lit(" good   ⚠ "), s("review"), F.lit(" review   ✗ "), s("poor"), F.lit(" failed\n"), T.thousands(F.col("words")), F.lit(" words extracted total.")).alias("text"))


def markdown_documents(docs: DataFrame, file_col: str = "file") -> DataFrame:
    """(file, slug, document): header and body of each document with pages."""
    s = lambda c: F.col(c).cast("string")
    lit = F.lit
    header = F.concat_ws(
        "\n", F.concat(lit("# "), T.stem(F.col(file_col))), lit(""), F.concat(lit("> Source: `"), F.col(file_col), lit("`")),
        F.concat(lit("> Pages extracted: "), s("pages_extracted"), lit(" (text: "), s("pages_via_text"), lit(", OCR: "), s("pages_via_ocr"), lit(") | Pages skipped: "), s("pages_skipped")),
        F.concat(lit("> Words: "), T.thousands(F.col("word_count")), lit(" | Avg page quality score: "), T.whole(F.col("avg_score")), lit("/100")),
        F.when(F.col("reason") != "", F.concat(lit("> Note: "), F.col("reason"))),
        F.when(F.size("warnings") > 0, F.concat(lit("> Warnings: "), F.array_join("warnings", "; "))),
        F.when(F.size("ocr_errors") > 0, F.concat(lit("> OCR exceptions: "), F.size("ocr_errors").cast("string"), lit(" pages"))),
        lit(""), lit("---"), lit(""), lit(""),
    )
    return docs.filter(F.col("pages_extracted") > 0).select(F.col(file_col).alias("file"), T.slugify(F.col(file_col)).alias("slug"), F.concat(header, F.col("markdown")).alias("document"))


def slug_collisions(docs: DataFrame, file_col: str = "file") -> DataFrame:
    """(slug, files) that would overwrite one another."""
    return docs.groupBy(T.slugify(F.col(file_col)).alias("slug")).agg(F.sort_array(F.collect_list(file_col)).alias("files")).filter(F.size("files") > 1)
