"""Choice between a page's embedded text and its OCR candidate.

Pages are (doc, page_num, text_raw, ocr_raw, ocr_error). `ocr_gate` says which pages need OCR at all, so that only these
reach an OCR adapter; `arbitrate` takes pages with candidates and picks one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.functions.quality import unreadable, with_quality


@dataclass(frozen=True)
class Rules:
    """Fixed values of the decision, and of what follows from it."""

    force_ocr: bool = False
    enough_text: float = 45.0  # below this score OCR runs
    broken_text: float = 0.10  # common-word ratio of a broken text layer
    sound_ocr: float = 0.30  # and of OCR that replaces it
    margin: float = 5.0
    least_score: float = 15.0  # pages below it are skipped
    min_pages: int = 20  # documents with fewer pages have no running lines
    least_hits: int = 5
    share_of_pages: int = 5  # one page in so many
    line_chars: tuple[int, int] = (3, 80)
    shown_errors: int = 50


RULES = Rules()


def with_text_score(pages: DataFrame, text_col: str = "text_raw") -> DataFrame:
    return with_quality(pages.withColumn("text_norm", T.normalize_encoding(text_col)), "text_norm", "text_score")


def needs_ocr(rules: Rules = RULES) -> Column:
    return F.lit(rules.force_ocr) | (F.col("text_score.score") < rules.enough_text)


def ocr_gate(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """pages with run_ocr."""
    return with_text_score(pages).withColumn("run_ocr", needs_ocr(rules))


def arbitrate(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(doc, page_num, method, text, score, text_score, ocr_score, ocr_error, branch). The first rule that holds decides."""
    df = pages if {"text_norm", "text_score", "run_ocr"} <= set(pages.columns) else ocr_gate(pages, rules)  # scored once
    df = df.withColumn("ocr_norm", F.when(F.col("run_ocr") & F.col("ocr_error").isNull(), T.normalize_encoding("ocr_raw")).otherwise(""))
    df = with_quality(df, "ocr_norm", "ocr_score")
    failed = unreadable(0, F.concat(F.lit("ocr exception: "), F.regexp_extract("ocr_error", r"\A([^:]*)", 1)))
    df = df.withColumn("ocr_score", F.when(F.col("ocr_error").isNotNull(), failed).otherwise(F.col("ocr_score")))
    t, o = F.col("text_score"), F.col("ocr_score")
    branch = (
        F.when(~F.col("run_ocr"), "gate")
        .when((t["common_word_ratio"] < rules.broken_text) & (o["common_word_ratio"] > rules.sound_ocr) & (T.strip(F.col("ocr_norm")) != ""), "broken_text")
        .when(o["score"] > t["score"] + rules.margin, "margin")
        .when(t["score"] > 0, "text")
        .when(o["score"] > 0, "ocr")
        .otherwise("none")
    )
    df = df.withColumn("branch", branch)
    by_ocr, b = F.col("branch").isin("broken_text", "margin", "ocr"), F.col("branch")
    return df.select(
        "doc", "page_num", F.when(by_ocr, "ocr").when(b == "none", "none").otherwise("text").alias("method"),
        F.when(by_ocr, F.col("ocr_norm")).when(b == "none", "").otherwise(F.col("text_norm")).alias("text"),
        F.when(by_ocr, o).otherwise(t).alias("score"),
        F.when(b != "none", t).alias("text_score"), F.when(~b.isin("none", "gate"), o).alias("ocr_score"),
        F.when(F.col("run_ocr"), F.col("ocr_error")).alias("ocr_error"), "branch",
    )
