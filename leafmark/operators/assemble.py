"""From arbitrated pages to documents: admission, cleaning, chunks, statistics, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark import scratch
from leafmark.functions import text as T
from leafmark.functions.correct import correct_misread_words
from leafmark.functions.quality import with_quality
from leafmark.operators.arbitrate import RULES, Rules, arbitrate
from leafmark.operators.boilerplate import with_running_lines


def page_chunks(judged: DataFrame, rules: Rules = RULES, keep: bool = True) -> DataFrame:
    """(doc, page_num, method, score, ocr_error, status, chunk) of arbitrated pages. status: extracted, skipped, or empty
    (nothing left after cleaning: skipped without a chunk).

    Judged pages are read twice, for running lines and for the chunks. keep: they are written to the shared folder in
    between, so that scoring runs once, and dealt again for the chunks."""
    if keep:
        judged = scratch.written(judged.select("doc", "page_num", "method", "text", "score", "ocr_error"), "judged-pages")
        df = with_running_lines(judged, rules, keep, scratch.dealt(judged, "doc", "page_num"))
    else:
        df = with_running_lines(judged, rules)
    out = (F.col("method") == "none") | (F.col("score.score") < rules.least_score)
    clean = correct_misread_words(T.drop_lines(F.col("text"), F.col("boilerplate")))
    clean = T.once(clean, lambda x: F.when(F.col("score.garbage_ratio") > 0, T.strip_garbage(x)).otherwise(x))  # it was counted
    clean = T.collapse_blank_lines(clean)
    df = df.withColumn("__out", out).withColumn("__clean", F.when(~out, clean))
    status = F.when(F.col("__out"), "skipped").when(F.col("__clean") == "", "empty").otherwise("extracted")
    reason = F.when(F.col("score.reason") == "", "low quality").otherwise(F.col("score.reason"))
    n = F.col("page_num").cast("string")
    chunk = (
        F.when(F.col("status") == "skipped", F.concat(F.lit("<!-- Page "), n, F.lit(": skipped ("), reason, F.lit(") -->")))
        .when(F.col("status") == "extracted", F.concat(F.lit("<!-- Page "), n, F.lit(" ("), F.col("method"), F.lit(", score="), T.whole(F.col("score.score")), F.lit(") -->\n"), F.col("__clean")))
    )
    return df.withColumn("status", status).withColumn("chunk", chunk).select("doc", "page_num", "method", F.col("score.score").alias("score"), "ocr_error", "status", "chunk")


def _in_order(value: Column, when: Column) -> Column:
    """Values of a document's pages in page order."""
    pairs = F.sort_array(F.collect_list(F.when(when, F.struct(F.col("page_num").alias("k"), value.alias("v")))))
    return F.transform(pairs, lambda x: x["v"])


def _sum(numbers: Column) -> Column:
    """In order, so that the result doesn't depend on partitions."""
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def documents(chunks: DataFrame) -> DataFrame:
    """A row for each document: counts, word_count, avg_score, markdown, ocr_errors. One shuffle, by document."""
    words = F.when(F.instr(F.substring("chunk", 1, 80), "skipped") == 0, T.n_tokens("chunk")).otherwise(0)
    extracted = F.col("status") == "extracted"
    df = chunks.withColumn("__words", F.when(F.col("chunk").isNotNull(), words)).groupBy("doc").agg(
        F.count_if(extracted).alias("pages_extracted"), F.count_if(~extracted).alias("pages_skipped"),
        F.count_if(extracted & (F.col("method") == "text")).alias("pages_via_text"), F.count_if(extracted & (F.col("method") == "ocr")).alias("pages_via_ocr"),
        F.coalesce(F.sum("__words"), F.lit(0)).cast("long").alias("word_count"),
        _in_order(F.col("score"), extracted).alias("__scores"), F.array_join(_in_order(F.col("chunk"), F.col("chunk").isNotNull()), "\n\n").alias("markdown"),
        _in_order(F.concat(F.lit("p"), F.col("page_num").cast("string"), F.lit(": "), F.col("ocr_error")), F.length("ocr_error") > 0).alias("ocr_errors"),
    )
    n = F.size("__scores")
    df = df.withColumn("avg_score", F.when(n > 0, _sum(F.col("__scores")) / n).otherwise(0.0)).drop("__scores")
    return df.withColumn("warnings", warnings()).withColumn("reason", reason())


def warnings() -> Column:
    low = F.when((F.col("avg_score") < 40) & (F.col("pages_extracted") > 0), F.concat(F.lit("Average page quality score "), T.whole(F.col("avg_score")), F.lit("/100 — review output")))
    many = F.when(F.col("pages_skipped") > F.col("pages_extracted"), F.concat(F.lit("More pages skipped ("), F.col("pages_skipped").cast("string"), F.lit(") than extracted ("), F.col("pages_extracted").cast("string"), F.lit(")")))
    return F.filter(F.array(low, many), lambda x: x.isNotNull())


def reason() -> Column:
    """Why a document came out as it did; the first that holds."""
    text, ocr, avg, errors = F.col("pages_via_text"), F.col("pages_via_ocr"), F.col("avg_score"), F.col("ocr_errors")
    share = lambda n: T.whole(100 * n / (text + ocr))
    kind = F.split(F.try_element_at(errors, F.lit(1)), ": ")
    kind = F.when(F.size(kind) > 1, F.get(kind, 1)).otherwise("error")
    return (
        F.when(F.size(errors) > 0, F.concat(F.lit("OCR failed on "), F.size(errors).cast("string"), F.lit(" pages ("), kind, F.lit(") — text layer used as fallback.")))
        .when(F.col("pages_extracted") == 0, "No pages extracted — source may be empty, encrypted, or unreadable.")
        .when(avg < 40, "Low-quality source — review recommended.")
        .when((ocr == 0) & (avg >= 60), "Clean embedded text — no OCR needed.")
        .when((text == 0) & (avg >= 60), "Scanned source — OCR used on every page.")
        .when((ocr > text * 2) & (ocr > 0), F.concat(F.lit("Broken text layer — recovered via OCR on "), ocr.cast("string"), F.lit(" pages.")))
        .otherwise(F.concat(F.lit("Mixed: "), share(text), F.lit("% text, "), share(ocr), F.lit("% OCR.")))
    )


def extract(pages: DataFrame, rules: Rules = RULES, keep: bool = True) -> DataFrame:
    """Documents of pages (doc, page_num, text_raw, ocr_raw, ocr_error). keep: see page_chunks."""
    return documents(page_chunks(arbitrate(pages, rules), rules, keep))


def chapters(items: DataFrame, least_words: int = 10) -> DataFrame:
    """Documents of EPUB chapters (doc, chapter_num, text). Chapters have no running lines, corrections or garbage to strip,
    and no page score: avg_score is 0, which grades every one of them as poor. Fixed behaviour."""
    df = with_quality(items.withColumn("text", T.normalize_encoding("text")), "text", "q")
    chunk = F.concat(F.lit("<!-- Chapter "), F.col("chapter_num").cast("string"), F.lit(" -->\n"), T.strip(F.col("text")))
    df = df.withColumn("chunk", F.when(F.col("q.word_count") >= least_words, chunk)).withColumnRenamed("chapter_num", "page_num")
    some = F.col("chunk").isNotNull()
    df = df.groupBy("doc").agg(
        F.count_if(some).alias("pages_extracted"), F.count_if(~some).alias("pages_skipped"),
        F.coalesce(F.sum(F.when(some, T.n_tokens("chunk"))), F.lit(0)).cast("long").alias("word_count"), F.array_join(_in_order(F.col("chunk"), some), "\n\n").alias("markdown"),
    )
    text = F.concat(F.lit("EPUB — "), F.col("pages_extracted").cast("string"), F.lit(" chapters extracted via HTML parsing."))
    none = F.array().cast("array<string>")
    return df.select(
        "doc", "pages_extracted", "pages_skipped", F.col("pages_extracted").alias("pages_via_text"), F.lit(0).cast("long").alias("pages_via_ocr"), "word_count", "markdown",
        none.alias("ocr_errors"), F.lit(0.0).alias("avg_score"), none.alias("warnings"), F.when(F.col("pages_extracted") > 0, text).otherwise("EPUB had no extractable chapters.").alias("reason"),
    )
