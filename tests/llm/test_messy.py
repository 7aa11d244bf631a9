"""Every operator on rows that go wrong, and on no rows."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leafmark.llm import ann, bpe, html_extract, license_scan, line_dedup, minhash, packing, quality_rules, substring_dedup, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
LABELS = "doc_id long, quality int, toxic int"


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_line_dedup(messy, empty):
    got = rows(line_dedup.drop_repeated_lines(messy, counts=True))
    assert len(got) == messy.count() and all(c in got[0] for c in messy.columns)
    by = {(r["doc_id"], r["id"]): r for r in got}
    assert by[(10, 13)]["text"] == "own line of ten" and by[(10, 13)]["n_dropped"] == 1
    assert by[(14, 17)]["n_dropped"] == 50 and by[(14, 17)]["text"] == ""
    assert by[(4, 4)]["text"] is None and by[(4, 4)]["n_lines"] == 1
    assert by[(None, 10)]["n_dropped"] == 0 and all(by[(i, n)]["n_dropped"] == 1 for i, n in ((1, 0), (2, 1), (2, 2)))  # the null id is the smallest
    assert rows(line_dedup.drop_repeated_lines(empty)) == []


def test_substring_dedup(messy, empty):
    got = {(r["doc_id"], r["id"]): r for r in rows(substring_dedup.drop_repeated_passages(messy, counts=True))}
    assert len(got) == messy.count()
    assert got[(16, 19)]["text"] == "fourteen" and got[(15, 18)]["n_removed"] == 0
    assert got[(None, 10)]["n_removed"] == 0 and got[(2, 2)]["n_removed"] == got[(2, 2)]["n_words"] == 600
    assert got[(12, 15)]["n_removed"] == 0 and got[(4, 4)]["text"] is None and got[(6, 6)]["text"] == "\n\n"
    assert rows(substring_dedup.drop_repeated_passages(empty)) == []


def test_near_dedup(messy, empty):
    got = {r["id"]: r["class_id"] for r in rows(minhash.near_duplicate_classes(messy))}
    assert len(got) == messy.select("doc_id").distinct().count()
    none = -(2**63)
    assert got[1] == got[2] == got[3] == got[none] == none and got[4] == 4 and got[5] == 5
    kept = minhash.keep_one_of_each(messy)
    assert kept.columns == messy.columns and {r["doc_id"] for r in rows(kept)} >= {None, 4, 5, 6, 7, 9, 10}
    assert not {r["doc_id"] for r in rows(kept)} & {1, 2, 3}
    assert rows(minhash.near_duplicate_classes(empty)) == []


def test_quality(messy, empty, spark):
    crf = quality_rules.train(messy, spark.createDataFrame([(1, 1, 0), (12, 0, 0), (None, 1, 1), (3, None, None), (1, 1, 0)], LABELS))
    got = rows(quality_rules.quality_verdicts(messy, crf))
    assert len(got) == messy.count() and all(r["base_failed"] for r in got if r["n_words"] < 20)
    kept = quality_rules.filter_by_quality(messy, crf)
    assert kept.columns == messy.columns and {1, 2, 3} <= {r["doc_id"] for r in rows(kept)}
    assert quality_rules.train(empty, spark.createDataFrame([], LABELS)) is None
    assert rows(quality_rules.quality_verdicts(empty, None)) == []


def test_packing(messy, empty):
    got = rows(packing.pack(messy, PATH))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len({r["doc_id"] for r in got}) == messy.select("doc_id").distinct().count() and all(r["length"] == 1 for r in got if r["doc_id"] in (4, 5))
    assert rows(packing.pack(empty, PATH)) == []


def test_bpe(messy, empty):
    got = rows(bpe.round_trip(messy, PATH))
    assert len(got) == messy.count()
    texts = sorted(r["text"] or "" for r in rows(messy))
    assert sorted(r["text"] for r in got) == texts
    assert rows(bpe.round_trip(empty, PATH)) == [] and rows(bpe.decode_ids(bpe.encode_texts(empty, PATH), PATH)) == []


def test_license(messy, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in rows(license_scan.scan(messy))}
    assert [r["labels"] for k, r in got.items() if k[0] == 13] == ["apache,apache-2.0"]
    assert got[(4, 0)]["labels"] == "" and got[(4, 0)]["first_word"] is None
    assert rows(license_scan.scan(empty)) == []


def test_toxicity(messy, empty, spark):
    model = toxicity.train(messy, spark.createDataFrame([(1, 1, 0), (8, 0, 1), (None, 1, 1), (3, 1, None), (8, 0, 0)], LABELS))
    got = rows(toxicity.toxicity_scores(messy, model))
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    none = toxicity.train(empty, spark.createDataFrame([], LABELS))
    assert rows(toxicity.toxicity_scores(empty, none)) == []


def test_html(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (1, "u", "", "t"), (None, "u", "<p>a<p>b", "t"), (2, "u", "<p>" + "long, " * 100_000, "t")], "page_id long, url string, html string, text string")
    got = rows(html_extract.extract_main_text(pages))
    assert sorted(r["text"] for r in got)[:3] == ["", "", "a\nb"] and max(len(r["text"]) for r in got) == 599_999
    assert rows(html_extract.extract_main_text(pages.limit(0))) == []


def test_ann(spark):
    odd = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (8, [0.5, 0.5], 1), (0, [1.0, 0.0], 1), (20, [float("inf"), 0.0], None)]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<float>, v int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(ann.nearest(df, F.col("vec_id") % 20 == 0)))
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, 0.5)]
    assert rows(ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0)) == []


@pytest.mark.parametrize("kind", ["messy", "empty"])
def test_stages(spark, request, tmp_path, kind):
    docs = request.getfixturevalue(kind)
    spark.createDataFrame([(1, 1, 0), (12, 0, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
    assert out.count() >= (1 if kind == "messy" else 0)


def test_digests_are_of_utf8():
    assert hashlib.sha256("é".encode()).hexdigest().startswith("4a99557e") and np.uint64(1) << np.uint64(3) == 8


CLASH = ["__id", "__tag", "__text", "__t1", "__t2", "__keep", "__bucket", "__new", "__new_text", "__n_words", "__n_lines", "__kept", "c0", "c1", "node", "a", "rank", "of total", "x.y"]


def test_columns_with_names_of_the_operators_pass_through(messy, spark):
    """Whatever other columns are called, they come out as they went in."""
    docs = messy.select("doc_id", "text", *[F.concat(F.lit(f"{i} "), F.col("id").cast("string")).alias(name) for i, name in enumerate(CLASH)])
    want = {tuple(r)[2:] for r in docs.collect()}
    crf = quality_rules.train(docs, spark.createDataFrame([(1, 1, 0), (12, 0, 0)], LABELS))
    for out in (line_dedup.drop_repeated_lines(docs), substring_dedup.drop_repeated_passages(docs)):
        assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == want
    for out in (quality_rules.filter_by_quality(docs, crf), minhash.keep_one_of_each(docs)):
        got = {tuple(r)[2:] for r in out.collect()}
        assert out.columns == docs.columns and got and got < want
    assert license_scan.scan(docs).count() == packing.pack(docs, PATH).select("doc_id", "piece", "length", "ids_crc32", "sequence_id").filter("piece = 0").count() == docs.count()


def test_repeated_ids_with_labels(messy, spark):
    """A labelled id that occurs again is one training row."""
    docs = messy.unionByName(messy).unionByName(messy.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" more"))))
    labels = spark.createDataFrame([(1, 1, 0), (12, 0, 1), (8, 0, 1), (3, 1, 0), (2, 1, 0)], LABELS)
    crf, model = quality_rules.train(docs, labels), toxicity.train(docs, labels)
    assert len(rows(quality_rules.quality_verdicts(docs, crf))) == len(rows(toxicity.toxicity_scores(docs, model))) == docs.count()


def test_repeated_page_ids(spark):
    pages = spark.createDataFrame([(1, "u", "<p>one, two"), (1, "v", "<p>three"), (1, "u", "<p>one, two"), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["url"] or "", r["text"]) for r in rows(html_extract.extract_main_text(pages))) == [(1, "u", "one, two"), (1, "u", "one, two"), (1, "v", "three"), (2, "", "")]
