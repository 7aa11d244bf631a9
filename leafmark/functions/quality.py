"""The text-quality score: common words, token length, garbage and size, as native columns.

`with_quality` takes several projections, white space first, then letters and their tokens, so that nothing is split or counted twice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.functions.vocabulary import common_words

QUALITY = "struct<score:double,word_count:int,common_word_ratio:double,garbage_ratio:double,avg_word_length:double,reason:string>"


def _quality(score: Column, n: Column, ratio: Column, garbage: Column, length: Column, reason: Column) -> Column:
    return F.struct(
        score.cast("double").alias("score"), n.cast("int").alias("word_count"), ratio.cast("double").alias("common_word_ratio"),
        garbage.cast("double").alias("garbage_ratio"), length.cast("double").alias("avg_word_length"), reason.alias("reason"),
    )


def unreadable(n: Column | int, reason: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return _quality(F.lit(0.0), lit(n), F.lit(0.0), F.lit(1.0), F.lit(0.0), lit(reason))


def _unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def with_quality(df: DataFrame, text_col: str, out: str, words: Iterable[str] | None = None) -> DataFrame:
    """df with a struct of the score and its parts. words: another vocabulary than the default."""
    known = sorted(set(common_words() if words is None else words) - {""})
    text = T.text_of(text_col)
    names = [_unused(df, x) for x in ("n", "alpha", "r", "g", "l", "m", "blanks", "letters")]
    at = dict(zip(("n", "alpha", "r", "g", "l", "m", "blanks", "letters"), names, strict=True))
    n, alpha, r, g, a, m, blanks, letters = (F.col(x) for x in names)
    df = df.withColumn(at["blanks"], T.blanks(text))
    df = df.withColumn(at["n"], T.n_parts(blanks)).withColumn(at["letters"], T.letters(blanks)).drop(at["blanks"])
    df = df.withColumn(at["alpha"], F.split(letters, " "))  # with empty parts: a blank less than parts
    df = df.withColumn(at["m"], F.size(F.array_remove(alpha, ""))).withColumn(at["l"], F.length(letters) - F.size(alpha) + 1)
    df = df.withColumn(at["r"], F.when(m > 0, F.size(F.filter(alpha, lambda x: x.isin(known))) / m))
    garbage = F.when(F.length(text) < F.octet_length(text), F.length(text) - F.length(T.strip_garbage(text))).otherwise(0)  # none in ASCII
    df = df.withColumn(at["g"], garbage / F.greatest(F.length(text), F.lit(1))).withColumn(at["l"], F.when(m > 0, a / m))
    fit = F.when((a < 2.5) | (a > 9), 0.3).when((a < 3) | (a > 7), 0.7).otherwise(1.0)
    score = 60 * r + 20 * fit - 100 * g + F.least(F.lit(20.0), 5 * (n / F.lit(50)))
    score = F.when((r < 0.15) & (a < 3.0) & (n > 30), score * 0.1).otherwise(score)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    quality = F.when(n == 0, unreadable(0, "empty")).when(m == 0, unreadable(n, "no alpha tokens")).otherwise(_quality(score, n, r, g, a, F.lit("")))
    return df.withColumn(out, quality).drop(*names)


def grade(score: Column) -> Column:
    return F.when(score >= 60, "✅ GOOD").when(score >= 40, "⚠️ REVIEW").otherwise("❌ POOR")


def live_grade(score: Column, pages: Column) -> Column:
    """The grade while running: no page is a failure."""
    return F.when(pages == 0, "❌ FAILED").otherwise(grade(score))
