"""Running lines: found over a document's pages, removed from each of them.

A line counts once a page, so the rows that are shuffled are (document, line) after a partial count. Lines that are
kept hold at least a fifth of the pages each, so that a document has at most five times as many of them as a page has
lines on average: the list that is joined back has a bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark import scratch
from leafmark.functions import text as T
from leafmark.operators.arbitrate import RULES, Rules


def running_lines(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(doc, line, n_pages) over pages (doc, text)."""
    least, most = rules.line_chars
    lines = F.array_distinct(F.filter(F.transform(F.split(T.text_of("text"), "\n"), T.strip), lambda x: F.length(x).between(least, most)))
    found = pages.select("doc", F.explode(lines).alias("line")).groupBy("doc", "line").agg(F.count("*").cast("long").alias("n_pages"))
    size = pages.groupBy("doc").agg(F.count("*").alias("pages")).filter(F.col("pages") >= rules.min_pages)
    enough = F.col("n_pages") >= F.greatest(F.lit(rules.least_hits), F.floor(F.col("pages") / rules.share_of_pages))
    return found.join(size, "doc").filter(enough).select("doc", "line", "n_pages")


def with_running_lines(pages: DataFrame, rules: Rules = RULES, keep: bool = False, to: DataFrame | None = None) -> DataFrame:
    """pages with the array boilerplate. keep: the lists are written first, so that their size is known and pages aren't shuffled to
    meet them where they are few. to: the same pages, dealt otherwise."""
    lists = running_lines(pages, rules).groupBy("doc").agg(F.collect_list("line").alias("boilerplate"))
    lists = scratch.written(lists, "running-lines") if keep else lists
    return (pages if to is None else to).join(lists, "doc", "left").withColumn("boilerplate", F.coalesce("boilerplate", F.array().cast("array<string>")))


def strip_running_lines(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """pages with the text without running lines and page numbers."""
    df = with_running_lines(pages, rules)
    return df.withColumn("text", T.drop_lines(T.text_of("text"), F.col("boilerplate"))).drop("boilerplate")
