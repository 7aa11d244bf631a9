"""Progress: smoothed ETA over ticks, percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as T

#: Fixed value: weight of the newest rate.
NEWEST = 0.25


def smoothed_rates(rates: Column) -> Column:
    """Exponential moving averages of an array, the first being the first rate itself."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        now = F.when(acc["last"].isNull(), x).otherwise(F.lit(NEWEST) * x + F.lit(1 - NEWEST) * acc["last"])
        return F.struct(now.alias("last"), F.concat(acc["all"], F.array(now)).alias("all"))

    return F.aggregate(rates, start, step, lambda acc: acc["all"])


def eta(ticks: DataFrame) -> DataFrame:
    """(file, tick, smoothed, eta, eta_text) of ticks (file, tick, elapsed, total). The first tick starts the clock: it has no
    rate yet. A file's ticks are folded in order, as each value needs the one before."""
    df = ticks.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("tick", "elapsed", "total"))).alias("t"))
    rates = F.transform(F.filter("t", lambda x: x["tick"] > 1), lambda x: x["tick"] / x["elapsed"])
    df = df.withColumn("s", smoothed_rates(rates)).select("file", F.posexplode("t").alias("i", "x"), "s")
    smoothed = F.when(F.col("i") > 0, F.get("s", F.col("i") - 1))
    left = (F.col("x.total") - F.col("x.tick")) / F.col("smoothed")
    df = df.select("file", F.col("x.tick").alias("tick"), "x", smoothed.alias("smoothed")).withColumn("eta", F.when(F.col("smoothed") > 0, left))
    return df.select("file", "tick", "smoothed", "eta", T.format_eta(F.col("eta")).alias("eta_text"))


def overall_percent(done: Column, n: Column) -> Column:
    return F.when(n > 0, (100 * done / n).cast("int")).otherwise(0)


def file_permille(done: Column, total: Column) -> Column:
    return F.when(total > 0, (1000 * done / total).cast("int")).otherwise(0)
