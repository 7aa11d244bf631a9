"""Folders and files of PDF and EPUB to Markdown and a QC report."""

from __future__ import annotations

import sys
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark import scratch
from leafmark.operators import assemble, report
from leafmark.operators.arbitrate import RULES, Rules, ocr_gate
from leafmark.sources import adapters, discover, sinks

RESULT_COLUMNS = ("doc", "pages_extracted", "pages_skipped", "pages_via_text", "pages_via_ocr", "word_count", "avg_score", "markdown", "ocr_errors", "warnings", "reason")


def extract_files(files: DataFrame, rules: Rules = RULES, readers: dict[str, Callable] | None = None, ocr: Callable[[str, int], str] | None = None) -> DataFrame:
    """Documents of files (file, kind, content), with their issues. Files are read once, and what they hold is written to the shared
    folder; pages are judged one by one, so that a long document is
    spread over tasks; only pages below the gate reach OCR. A file that can't be opened has no pages and an issue."""
    read = scratch.written(adapters.read_files(files, readers), "read-pages")
    opened, failed = read.filter("page_num IS NOT NULL"), read.filter("page_num IS NULL").select(F.col("file").alias("doc"), F.array("error").alias("issues"))
    pages = opened.filter("kind <> 'epub'").select(F.col("file").alias("doc"), "file", "page_num", F.col("text").alias("text_raw"))
    if ocr is not None:
        pages = scratch.written(ocr_gate(pages, rules), "gated-pages")
    books = assemble.extract(adapters.with_ocr(pages, ocr), rules).select(*RESULT_COLUMNS)
    chapters = assemble.chapters(opened.filter("kind = 'epub'").select(F.col("file").alias("doc"), F.col("page_num").alias("chapter_num"), "text")).select(*RESULT_COLUMNS)
    docs = files.select(F.col("file").alias("doc")).join(books.unionByName(chapters), "doc", "left").join(failed, "doc", "left")
    none = F.array().cast("array<string>")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in RESULT_COLUMNS[1:6]} | {c: F.coalesce(c, none) for c in ("ocr_errors", "warnings", "issues")}
    return docs.withColumns(zero | {"avg_score": F.coalesce("avg_score", F.lit(0.0)), "markdown": F.coalesce("markdown", F.lit("")), "reason": F.coalesce("reason", F.lit(""))}).withColumnRenamed("doc", "file")


class Extraction:
    """One run over files and folders. `run` may be in a thread of its own; `cancel` stops its jobs, `percent` tells how far its tasks are."""

    def __init__(self, spark: SparkSession, sources: Iterable[str], out: str | None = None, force_ocr: bool = False, skip_existing: bool = True, readers: dict[str, Callable] | None = None, ocr: Callable[[str, int], str] | None = None) -> None:
        self.spark, self.sources = spark, [str(s) for s in sources]
        self.out = out or discover.output_folder(self.sources)
        self.rules, self.skip_existing, self.readers, self.ocr = replace(RULES, force_ocr=force_ocr), skip_existing, readers, ocr
        self.group, self.stopped, self.done = f"extraction-{uuid.uuid4().hex}", threading.Event(), False

    def cancel(self) -> None:
        self.stopped.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def percent(self) -> int:
        """Finished tasks among those of the jobs that are known by now."""
        tracker = self.spark.sparkContext.statusTracker()
        if self.done:
            return 100
        stages = [s for j in tracker.getJobIdsForGroup(self.group) if (job := tracker.getJobInfo(j)) for i in job.stageIds if (s := tracker.getStageInfo(i))]
        total = sum(s.numTasks for s in stages)
        return 100 * sum(s.numCompletedTasks for s in stages) // total if total else 0

    def run(self) -> DataFrame | None:
        """Writes Markdown files and _QC_REPORT.md to the output folder, which executors must share; the results, or None where there
        is nothing to do (then no report is written) or the run was stopped."""
        self.spark.sparkContext.setJobGroup(self.group, "extraction", True)
        since = scratch.mark()
        try:
            return None if self.stopped.is_set() else self._run()
        except Exception:
            if self.stopped.is_set():
                return None
            raise
        finally:
            if self.stopped.is_set():
                scratch.delete(since)
            self.done = True
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def _run(self) -> DataFrame | None:
        spark, out, began = self.spark, Path(self.out), time.monotonic()
        found = discover.collect_files(spark, self.sources)
        if found.isEmpty():
            return None
        out.mkdir(parents=True, exist_ok=True)
        todo, done = found, None
        if self.skip_existing:
            outputs = spark.createDataFrame([(p.name, p.stat().st_size) for p in out.glob("*.md")] or [("", 0)], "slug string, size long")
            todo = discover.skip_existing(found, outputs)
            done = report.existing(found.join(todo.select("path"), "path", "left_anti"))
        since = scratch.mark()
        docs = scratch.written(extract_files(discover.with_content(todo), self.rules, self.readers, self.ocr), "documents")
        sinks.write_markdown(docs, str(out))
        results = report.results(docs, issues=F.col("issues"))
        results = scratch.written(results.unionByName(done) if done is not None else results, "results")
        sinks.write_qc_report(results, str(out / "_QC_REPORT.md"))
        for n, row in enumerate(report.log_lines(results).orderBy("file").toLocalIterator(), 1):
            print(f"[{n}] {row.line}", file=sys.stderr)
        print(report.summary_text(report.run_summary(results), time.monotonic() - began).first().text, file=sys.stderr)
        scratch.delete(since, but=(results,))
        return results


def run_folder(spark: SparkSession, source: str, out: str, force_ocr: bool = False, skip_existing: bool = True, readers: dict[str, Callable] | None = None, ocr: Callable[[str, int], str] | None = None) -> DataFrame | None:
    return Extraction(spark, [source], out, force_ocr, skip_existing, readers, ocr).run()
