import hashlib
import random

import model
import pytest
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.functions.correct import correct_misread_words
from leafmark.functions.quality import with_quality
from leafmark.functions.vocabulary import common_words, corrections


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_vocabulary_is_closed():
    assert len(common_words()) == 370
    assert hashlib.sha256(" ".join(sorted(common_words())).encode()).hexdigest() == "9c9e44facb262497f8b93520efc9f9f2391bad408c2f5c18aecf0b7f14b1d72f"
    assert len(corrections()) == 440
    assert sum(k[0].isdigit() for k in corrections()) == 38


def test_normalize(spark):
    got = column(spark, ["ﬄ", "(cid:12)a(c­id:3)", "‘x’… “y”", "a b c", "—\u0097–", None, ""], T.normalize_encoding)
    assert got == ["fiffl", "a", "'x'... \"y\"", "a\nb\n\nc", "——-", "", "•"]
    again = column(spark, got, T.normalize_encoding)
    assert again == got


def test_garbage(spark):
    assert column(spark, ["ab�cé", None], T.strip_garbage) == ["abcé", ""]


@pytest.mark.parametrize(
    ("name", "slug"),
    [("My Book (2nd) [x].pdf", "my-book-2nd-x.md"), ("书.pdf", ".md"), ("a  b--c.epub", "a-b-c.md"), ("-x-.pdf", "-x-.md"), (".hidden", "hidden.md"), ("a.b.pdf", "ab.md")],
)
def test_slugify(spark, name, slug):
    assert column(spark, [name], T.slugify) == [slug]


def test_package_slug(spark):
    assert column(spark, ["  __Hello, World!__ ", "!!!", None, "Été 1"], T.package_slug) == ["hello-world", "skill", "skill", "été-1"]


def test_eta(spark):
    assert column(spark, [42.0, 192.0, 3900.0, -1.0, None, float("nan"), 59.9], T.format_eta, "double") == ["42s", "3m 12s", "1h 5m", "…", "…", "…", "59s"]


def test_half_to_even(spark):
    assert column(spark, [62.5, 63.5, 0.4], T.whole, "double") == ["62", "64", "0"]


def test_lines(spark):
    got = column(spark, ["1234\n12345\n  7  \n  kept\nrun"], lambda c: T.drop_lines(c, F.array(F.lit("run"))))
    assert got == ["12345\n  kept"]


def test_score_vectors(spark):
    texts = ["The cat sat on the mat", "rnoney is good", "12", "   ", "x" * 40 + "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    q = [r.q for r in with_quality(df, "t", "q").orderBy("i").collect()]
    assert [round(x.score, 2) for x in q] == [44.6, 60.3, 0.0, 0.0, 3.66, 0.0]
    assert [x.reason for x in q] == ["", "", "no alpha tokens", "empty", "", "empty"]


def _texts(n, seed):
    r = random.Random(seed)
    words = sorted(common_words()) + ["tirne", "Tirne,", "TIRNE", "c0rne", "0ne", "Bernard", "rnoney", "w0rld!", "cloes", "xyzzy", "été", "12", "", "wi1l", "vvork"]
    gaps = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85"]
    return ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_score_matches_model(spark):
    texts = _texts(300, 1)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(7)
    for r in with_quality(df, "t", "q").collect():
        assert tuple(r.q) == model.score(texts[r.i])
        assert 0 <= r.q.score <= 100


def test_correct_matches_model(spark):
    texts = [*_texts(300, 2), "c0rne", "tirne Tirne, TIRNE", "0ne Bernard"]
    assert column(spark, texts, correct_misread_words) == [model.correct(t) for t in texts]
