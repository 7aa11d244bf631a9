"""Which files a run works on."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.functions import text as T

SUPPORTED = r"(?i)\.(pdf|epub)$"
#: Outputs of more bytes are not made again.
ENOUGH_BYTES = 1000


def supported(path: Column) -> Column:
    return path.rlike(SUPPORTED)


def scan_folder(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """PDF and EPUB files of one folder (not of those in it), as binaryFile has them, with file and kind. In order of path without
    content; with it they aren't sorted, as that would shuffle the files' bytes."""
    df = spark.read.format("binaryFile").load(folder)
    df = df if content else df.drop("content").orderBy("path")
    return _named(df.filter(supported(F.col("path"))))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.regexp_extract("path", r"([^/]*)\z", 1)).withColumn("kind", F.lower(F.regexp_extract("path", SUPPORTED, 1)))


def collect_files(spark: SparkSession, sources: Iterable[str]) -> DataFrame:
    """(path, source_ord, child, file, kind) of a mix of files and folders: files as given, those of a folder (not of folders in it) by name;
    a path that comes twice counts where it comes first. What is neither a supported file nor a folder is left out."""
    rows = []
    for n, source in enumerate(map(Path, sources)):
        if source.is_dir():
            rows += [(n, k, str(p)) for k, p in enumerate(sorted(p for p in source.iterdir() if p.is_file()))]
        elif source.is_file():
            rows.append((n, 0, str(source)))
    items = spark.createDataFrame(rows, "source_ord int, child int, path string")
    return _named(dedupe_sources(items)).orderBy("source_ord", "child")


def with_content(files: DataFrame) -> DataFrame:
    """files (path, file, kind) with their content; the paths of a run are few enough for its plan, their bytes are read by the tasks."""
    paths = [re.sub(r"([\\[\]{}*?])", r"\\\1", r.path) for r in files.select("path").collect()]
    if not paths:
        return files.select("path", "file", "kind").withColumn("content", F.lit(None).cast("binary"))
    return _named(files.sparkSession.read.format("binaryFile").load(paths))


def dropped_paths(urls: Iterable[str]) -> list[str]:
    """Of dropped URLs, the local folders and supported files, each once, in their order."""
    found = {}
    for url in urls:
        at = urlsplit(url)
        path = Path(unquote(at.path))
        if at.scheme == "file" and at.netloc in ("", "localhost") and at.path and (path.is_dir() or (path.is_file() and path.suffix.lower() in (".pdf", ".epub"))):
            found[str(path)] = None
    return list(found)


def output_folder(sources: Iterable[str]) -> str:
    """Where the outputs go: in the folder if it is the only source, else beside the first file (or, without any, the first folder)."""
    paths = [Path(s) for s in sources]
    if len(paths) == 1 and paths[0].is_dir():
        return str(paths[0] / "extracted")
    first = next((p for p in paths if p.is_file()), paths[0])
    return str(first.parent / "extracted")


def dedupe_sources(items: DataFrame) -> DataFrame:
    """(path, ord) of items (source_ord, child, path): supported files, in order of source and child, each path once where it
    comes first. Partitioned by path: no task sees all rows before the numbering of what is left."""
    first = F.row_number().over(Window.partitionBy("path").orderBy("source_ord", "child"))
    return items.filter(supported(F.col("path"))).withColumn("__k", first).filter("__k = 1").select("path", "source_ord", "child")


def skip_existing(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """files (file) whose output (slug, size) isn't there, or is too small to be whole. Done before content is read."""
    done = outputs.filter(F.col("size") > ENOUGH_BYTES).select(F.col("slug").alias("__slug")).distinct()
    return files.withColumn("__slug", T.slugify(F.col("file"))).join(done, "__slug", "left_anti").drop("__slug")
