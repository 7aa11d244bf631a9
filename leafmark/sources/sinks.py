"""Where results go: Markdown files and the QC report."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row

from leafmark.operators import report

TABLE = ("| # | File | Pages | Text | OCR | Skipped | Words | Score | Grade | Notes |", "|---|------|-------|------|-----|---------|-------|-------|-------|-------|")


def write_markdown(docs: DataFrame, folder: str, file_col: str = "file") -> None:
    """One file for each document with pages, written by the executors: `folder` must be one that they share."""

    def run(rows: Iterator[Row]) -> None:
        for r in rows:
            Path(folder, r["slug"]).write_text(r["document"], encoding="utf-8")

    Path(folder).mkdir(parents=True, exist_ok=True)
    report.markdown_documents(docs, file_col).foreachPartition(run)


def qc_report(results: DataFrame) -> Iterator[str]:
    """Lines of the report, streamed to the driver in order."""
    n = results.count()
    yield from ("# Extraction QC Report", "", f"_Generated by leafmark · {n} books_", "", *TABLE)
    for r in report.qc_rows(results).orderBy("n").toLocalIterator():
        yield r["row"]
    file = None
    for r in report.ocr_appendix(results).orderBy("file", "pos").toLocalIterator():
        if file is None:
            yield from ("", "---", "", "## OCR exceptions (detail)", "")
        if r["file"] != file:
            if file is not None:
                yield ""
            file = r["file"]
            yield from (f"### {file}", "")
        yield r["line"]
    if file is not None:
        yield ""


def write_qc_report(results: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in qc_report(results))
