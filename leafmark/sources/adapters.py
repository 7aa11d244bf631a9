"""Readers of files: one row for each page or chapter, errors as a column. Those of PDF and OCR need libraries that may be missing."""

from __future__ import annotations

import importlib
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.sources.html import text_lines


class ExtractorUnavailable(RuntimeError):
    """A library that a kind of source needs isn't there."""


class PageReader(Protocol):
    def __call__(self, content: bytes) -> Iterator[tuple[int, str | None, str | None]]:
        """(page number, text, error) of each page."""


def read_epub(content: bytes) -> Iterator[tuple[int, str | None, str | None]]:
    """Chapters in order of the package's manifest; numbers count every document in it, also those that can't be read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        n = 0
        for item in ElementTree.fromstring(z.read(opf)).iter():
            if not item.tag.endswith("}item") or item.attrib.get("media-type") != "application/xhtml+xml":
                continue
            n += 1
            try:
                name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(item.attrib["href"])))
                yield n, text_lines(z.read(name).decode("utf-8", "replace")), None
            except Exception as e:
                yield n, None, f"{type(e).__name__}: {e}"


def read_pdf(content: bytes) -> Iterator[tuple[int, str | None, str | None]]:
    """Embedded text of each page; a page that can't be read has none."""
    try:
        fitz = importlib.import_module("fitz")
    except ImportError as e:
        raise ExtractorUnavailable("PyMuPDF is not installed") from e
    with fitz.open(stream=content, filetype="pdf") as document:
        for number in range(1, len(document) + 1):
            try:
                text = document[number - 1].get_text("text")
            except Exception:
                text = None
            yield number, text or "", None


READERS: dict[str, PageReader] = {"epub": read_epub, "pdf": read_pdf}
FAILED = {"epub": "EPUB read failed: ", "pdf": "Failed to open PDF: "}


def read_files(files: DataFrame, readers: dict[str, Callable] | None = None) -> DataFrame:
    """(file, kind, page_num, text, error) of files (file, kind, content). A file that can't be opened gives one row without a
    page number; nothing is raised."""
    readers = READERS if readers is None else readers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, kind, content in zip(b["file"], b["kind"], b["content"], strict=True):
                rows = []
                try:
                    if kind not in readers:
                        raise ExtractorUnavailable(f"no reader for {kind}")
                    rows = [(file, kind, n, text, error) for n, text, error in readers[kind](bytes(content))]
                except Exception as e:
                    rows.append((file, kind, None, None, FAILED.get(kind, "") + str(e)))
                yield pd.DataFrame(rows, columns=["file", "kind", "page_num", "text", "error"]).astype({"page_num": "Int64"})

    return files.select("file", "kind", "content").mapInPandas(run, "file string, kind string, page_num long, text string, error string")


def with_ocr(pages: DataFrame, ocr: Callable[[str, int], str] | None, gate: str = "run_ocr") -> DataFrame:
    """pages (file, page_num, ...) with ocr_raw and ocr_error. Only pages that the gate lets through reach the engine: they are
    filtered before Python and joined back by file and page."""
    if ocr is None:
        return pages.withColumn("ocr_raw", F.lit(None).cast("string")).withColumn("ocr_error", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, n in zip(b["file"], b["page_num"], strict=True):
                try:
                    rows.append((file, n, ocr(file, int(n)), None))
                except Exception as e:
                    rows.append((file, n, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file", "page_num", "ocr_raw", "ocr_error"])

    done = pages.filter(gate).select("file", "page_num").mapInPandas(run, "file string, page_num long, ocr_raw string, ocr_error string")
    return pages.join(done, ["file", "page_num"], "left")


def health(ocr: Callable[[bytes], str], picture: bytes) -> tuple[bool, str]:
    """Whether an OCR engine reads either word of a picture that says "Hello world"."""
    try:
        seen = ocr(picture)
    except Exception as e:
        return False, f"{type(e).__name__}: {e}"
    ok = bool(re.search("hello|world", seen, re.I))
    return ok, "ok" if ok else f"unexpected result: {seen!r}"
