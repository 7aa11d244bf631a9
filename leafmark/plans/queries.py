"""The registered queries: each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.functions.correct import correct_misread_words
from leafmark.functions.quality import grade, live_grade, with_quality
from leafmark.operators import assemble, boilerplate, export, progress, report
from leafmark.operators.arbitrate import arbitrate, ocr_gate
from leafmark.plans import inputs as I
from leafmark.sources import discover, html


def _md5(c):
    return F.md5(c.cast("binary") if not isinstance(c, str) else F.col(c).cast("binary"))


def spread(df: DataFrame) -> DataFrame:
    """A small file is one partition; heavy expressions on it want all cores."""
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(n) if size < n * (32 << 20) else df


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(I.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return with_quality(docs, "text", "q").select("doc_id", "q.*")


def quality_grade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_score(spark, sf_dir)
    return q.groupBy(grade(F.col("score")).alias("grade")).agg(F.count("*").alias("n_docs"), F.sum("word_count").alias("words"), F.min("score").alias("least"), F.max("score").alias("most"))


def normalize_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.dirty_text(spark, sf_dir).withColumn("t", T.normalize_encoding("text_raw"))
    return df.select("doc_id", _md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


def garbage_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.dirty_text(spark, sf_dir).withColumn("t", T.strip_garbage("text_raw"))
    return df.select("doc_id", _md5("t").alias("digest"), (F.length("text_raw") - F.length("t")).cast("long").alias("n_garbage"))


def ocr_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.dirty_text(spark, sf_dir).withColumn("t", correct_misread_words("text_raw"))
    return df.select("doc_id", _md5("t").alias("digest"), (F.col("t") != F.col("text_raw")).alias("changed"))


def _dirty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dirty_text(spark, sf_dir).withColumn("text", T.normalize_encoding("text_raw"))


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.running_lines(_dirty_pages(spark, sf_dir))


def strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = boilerplate.strip_running_lines(_dirty_pages(spark, sf_dir))
    return df.select("doc_id", _md5(T.collapse_blank_lines(F.col("text"))).alias("digest"))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(I.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text_raw")))
    return ocr_gate(docs).select("doc_id", "run_ocr")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arbitrate(spread(I.candidates(spark, sf_dir)))


def page_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc", "page_num", "branch", "method", "score.score", "score.reason", "ocr_error", _md5("text").alias("digest"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.page_chunks(_judged(spark, sf_dir))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc", "page_num", "status", "chunk")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.documents(_chunks(spark, sf_dir))


def document_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc", _md5("markdown").alias("digest"), F.length("markdown").cast("long").alias("n_chars"))


def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc", "pages_extracted", "pages_skipped", "pages_via_text", "pages_via_ocr", "word_count", "avg_score", F.array_join("warnings", "; ").alias("warnings"))


def document_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc", "reason", grade(F.col("avg_score")).alias("grade"), live_grade(F.col("avg_score"), F.col("pages_extracted")).alias("live_grade"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("file", F.concat("doc", F.lit(".pdf")))


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.markdown_documents(_files(spark, sf_dir)).select("file", "slug", _md5("document").alias("digest"))


def qc_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.qc_rows(report.results(_files(spark, sf_dir)))


def ocr_error_appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ocr_appendix(report.results(_files(spark, sf_dir)))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.run_summary(report.results(_files(spark, sf_dir)))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(I.table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", html.parsed_html("html").alias("text"))


def html_to_text_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(I.table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", html.native_html("html").alias("text"))


def chapter_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = I.html_chapters(spark, sf_dir).withColumn("text", html.parsed_html("html"))
    return assemble.chapters(items).select("doc", "pages_extracted", "pages_skipped", "word_count", _md5("markdown").alias("digest"), "reason")


def slugify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") [x].pdf"))
    return I.table(spark, sf_dir, "part").select("p_partkey", T.slugify(name).alias("slug"))


def slugify_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "pages").select("page_id", T.package_slug(F.concat(F.lit(" __"), "url", F.lit("! "))).alias("slug"))


def dedupe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    path = F.concat("source", F.when(k == 0, ".pdf").when(k == 1, ".EPUB").otherwise(".txt"))
    items = I.table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("source_ord"), F.col("doc_id").alias("child"), path.alias("path"))
    return discover.dedupe_sources(items)


def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = I.table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("file"), (F.col("p_size") * 40).alias("size"))
    return discover.skip_existing(files.select("file"), files.select(T.slugify(F.col("file")).alias("slug"), "size"))


def eta_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.eta(I.ticks(spark, sf_dir)).select("file", "tick", F.round("smoothed", 6).alias("smoothed"), F.round("eta", 4).alias("eta"), "eta_text")


def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.ticks(spark, sf_dir)
    return df.select("file", "tick", progress.overall_percent(F.col("tick"), F.col("total")).alias("overall"), progress.file_permille(F.col("tick"), F.col("total")).alias("permille"))


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = I.table(spark, sf_dir, "documents").select(F.concat("source", F.lit(".md")).alias("file")).distinct()
    return export.manifest(files, F.lit("My Corpus"), "out")


def export_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that each target's prompt lists, and whether name, description and folder stand in it."""
    df = export.prompts(export_manifest(spark, sf_dir), "My Corpus", "what it holds", "out")
    listed = F.array_join(F.filter(F.split("prompt", "\n"), lambda x: x.startswith("- `")), "\n")
    holds = lambda x: F.contains("prompt", F.lit(x) if isinstance(x, str) else x)
    return df.select("target", "package", _md5(listed).alias("digest"), (holds("My Corpus") & holds("what it holds") & holds(F.concat(F.lit("out/"), "package")) & ~holds("{{") & ~holds("{name}")).alias("filled"))


def qc_report_of_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows of files that could not be opened, and of files that were there already."""
    part = I.table(spark, sf_dir, "part").withColumn("file", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".pdf")))
    odd = F.col("p_partkey") % 2 == 1
    empty = {c: F.lit(0).cast("long") for c in ("pages_extracted", "pages_skipped", "pages_via_text", "pages_via_ocr", "word_count")} | {c: F.array().cast("array<string>") for c in ("warnings", "ocr_errors")}
    failed = part.filter(odd).withColumns(empty | {"avg_score": F.lit(0.0), "reason": F.lit("")})
    rows = report.results(failed, issues=F.array(F.concat(F.lit("Failed to open PDF: "), "p_name"), F.lit("no such page")))
    return report.qc_rows(rows.unionByName(report.existing(part.filter(~odd))))


QUERIES = {
    f.__name__: f
    for f in (
        quality_score, quality_grade_summary, normalize_encoding, garbage_strip, ocr_correct, boilerplate_lines, strip_boilerplate, page_arbitration, page_chunks,
        document_assembly, document_stats, document_reason, markdown_documents, qc_report_rows, ocr_error_appendix, run_summary, html_to_text, html_to_text_native,
        chapter_assembly, slugify_names, slugify_packages, dedupe_sources, skip_existing, eta_ema, progress_percent, export_manifest, export_prompts, qc_report_of_failures,
    )
} | {"ocr_gate": gate}
