"""What the operators of this subpackage share: table access, batch limits, cut points, id handling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.scratch import delete, mark, new_folder, shared_dir, table_name, written

__all__ = ["delete", "mark", "written"]
#: Identity of rows whose id is null: one document, smaller than every other.
NULL_ID = -(2**63)
#: Bytes of text that one step of a Python worker holds at once (a longer single text is its own step).
STEP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint; Spark removes its files once nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, name: str, key: str, files: int) -> DataFrame:
    """Like `written`, bucketed by a column: what groups by it later reads the table without a shuffle."""
    spark = df.sparkSession
    at = new_folder(spark, name, catalog=True)
    df.repartition(files, key).write.format("parquet").bucketBy(files, key).sortBy(key).option("path", at).saveAsTable(table_name(at))
    return spark.table(table_name(at))


def small_batches(spark: SparkSession, records: int = 2000) -> None:
    """Bounds the Arrow batches between the JVM and Python by rows and, where Spark can, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * STEP_BYTES))


def ident(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def tags(text_col: str) -> tuple[Column, Column]:
    """128 bits that tell rows of one id with different texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit("again"), text)


def inner(docs: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """docs with its columns named by place, so that no name can clash with one of an operator's own; these names and the types."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, [f.dataType.simpleString() for f in docs.schema.fields]


def steps(batches: Iterator[pa.RecordBatch], most: int = STEP_BYTES, column: int | str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts each batch to slices of about `most` bytes of text."""
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(b.schema.get_field_index(column)) if isinstance(column, str) else b.column(column)
        if c.nbytes <= most:
            yield b
            continue
        lengths = pc.fill_null(pc.binary_length(c), 0).to_pylist()
        at = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        yield b.slice(at)


def gathered(batches: Iterator[pa.RecordBatch], most: int = STEP_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes, small batches put together; for steps that pre-aggregate."""
    held, size = [], 0
    for b in steps(batches, most, column):
        n = b.column(b.schema.get_field_index(column)).nbytes
        if held and size + n > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
