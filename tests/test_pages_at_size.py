"""What pages cost: texts that hold nothing to mend pass whole, and pages stay where they are for short lists."""

import random

import model
from pyspark.sql import functions as F

from leafmark import scratch
from leafmark.functions import text as T
from leafmark.functions.correct import correct_misread_words
from leafmark.functions.quality import with_quality
from leafmark.functions.vocabulary import corrections
from leafmark.operators import assemble
from leafmark.operators.arbitrate import arbitrate
from leafmark.plans.inputs import CLEAN

PAGES = "doc string, page_num int, text_raw string, ocr_raw string, ocr_error string"


def test_pages_are_not_shuffled_to_meet_short_lists(spark):
    rows = [("d", n, f"Running header\n{CLEAN * 12}", None, None) for n in range(1, 31)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")  # less than the pages, more than the list
    try:
        chunks = assemble.page_chunks(arbitrate(spark.createDataFrame(rows, PAGES)))
        plan = chunks._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert all(r.chunk.startswith(f"<!-- Page {r.page_num} (text") and "Running header" not in r.chunk for r in chunks.collect())


def test_garbage_that_was_counted_is_stripped(spark):
    judged = arbitrate(spark.createDataFrame([("d", 1, CLEAN * 12 + " end", None, None), ("d", 2, CLEAN * 12 + "end", None, None)], PAGES))
    got = {r.page_num: r.chunk for r in assemble.page_chunks(judged).collect()}
    assert got[1].endswith("book  end") and got[2].endswith("book end")


def test_rows_are_dealt_to_all_cores(spark):
    assert scratch.dealt(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_columns_match_model_on_odd_texts(spark):
    r = random.Random(8)
    keys = sorted(corrections())
    bits = [*T.WS_CHARS, *"\n" * 9, *" " * 30, "(cid:", "12", ")", "(ci\xadd:3)", "٣", "K", "İ", "ſ", "x", "the", "People", "frorn", "FRORN,", "(tirne)", "\U0001f600", "￿", "", "…", "“", "é", "-", "\0", "\x1b", *keys, *map(str.upper, keys)]
    texts = ["".join(r.choice(bits) for _ in range(r.choice([0, 1, 2, 5, 20, 60]))) for _ in range(1500)]
    texts += [" ".join(r.choice([k, k.title(), k + ".", k + "x", f"({k})", k.replace("k", "K")]) for k in r.choices(keys, k=6)) for _ in range(1500)]
    df = with_quality(spark.createDataFrame([(x,) for x in texts], "t string").repartition(4), "t", "q")
    for row in df.select("t", "q", T.n_tokens("t").alias("n"), correct_misread_words("t").alias("c"), T.strip(F.col("t")).alias("s"), T.drop_lines(F.col("t"), F.array().cast("array<string>")).alias("d")).collect():
        t = row.t
        assert (row.n, row.c, row.s, row.d) == (len(t.split()), model.correct(t), t.strip(), model.strip_lines(t, set()))
        assert all(a == b if isinstance(a, str) else abs(a - b) < 1e-9 for a, b in zip(row.q, model.score(t), strict=True))
