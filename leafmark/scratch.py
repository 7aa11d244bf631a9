"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables that results may still read, and whether the catalog knows them.
_WRITTEN: dict[str, bool] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="leafmark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def new_folder(spark: SparkSession, name: str, catalog: bool = False) -> str:
    if not _WRITTEN:
        atexit.register(delete, 0)
    at = f"{shared_dir(spark)}/leafmark/{name}-{uuid.uuid4().hex}"
    _WRITTEN[at] = catalog
    return at


def mark() -> int:
    return len(_WRITTEN)


def delete(since: int, keep_last: bool = False, but: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the folders that were made since a mark, but for those of some tables, for callers that have written what they made of
    them; all that is left goes when the driver's process ends with a session."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    kept = {f.rpartition("/")[0].rpartition("/")[2] for df in but for f in df.inputFiles()}
    for at in list(_WRITTEN)[since : len(_WRITTEN) - keep_last]:
        if at.rpartition("/")[2] in kept:
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if _WRITTEN.pop(at):
            spark.sql(f"DROP TABLE IF EXISTS {table_name(at)}")


def table_name(at: str) -> str:
    return f"leafmark_{at[-32:]}"


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by a key to several tasks for each core if they are many: heavy expressions want all cores to the end, and tasks that
    are made by bytes alone come to one and a bit for each core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    mb = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >> 20
    return df.repartition(max(cores, min(4 * cores, mb), min(mb // 32, 20_000)), *by)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a compressed table: made once, and read again if an executor is lost."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
