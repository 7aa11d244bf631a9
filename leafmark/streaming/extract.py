"""The same columns on streams: pages are scored as they come; documents are made once they are complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafmark.operators.arbitrate import RULES, Rules, arbitrate
from leafmark.operators.assemble import extract


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder, as binaryFile has them."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def judged_pages(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Stateless: each page is arbitrated when it arrives."""
    return arbitrate(pages, rules)


def documents(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, rules: Rules = RULES) -> StreamingQuery:
    """Documents of each micro-batch. Running lines need all of a document's pages, so a batch must hold whole documents (as it does
    when a file is the unit of input)."""
    return pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: sink(extract(df, rules, keep=False), n)).start()
