"""Toxicity (4): a factorization machine over hashed terms.

A text's terms are its words, in lower case and without marks at the ends, and the words' beginnings of STEMS letters;
each is hashed to one of 2**22 numbers; one that occurs c times counts x = 1 + ln c. The score is
sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j / n), over the n terms of the text that the model has factors for: pairs such as an insult with the mention of a group have a weight of
their own, which a sum of weights alone can't give them.

Training reads labels of rows whose crc32(doc_id as text) mod 5 is not 0, at most `most` of them (half of each
label, chosen by a hash of the id; of an id that occurs again, its smallest text), with their whole texts and all their terms; the share of the labels
among all these rows sets the intercept. No number of terms is fixed. Weights have an L1 penalty, so that terms whose weight the
rows don't support are exactly 0: one that no more than penalty * rows of them hold can't have a weight at all and is left out from the start.
Factors have an L2 penalty that no single row can overcome; those of terms that it takes to 0 are dropped. They are not chosen by what a term says alone:
terms that only tell labels apart in pairs have them too. The penalty is chosen on a quarter of the training rows.
Labels, languages, sources and ids are no inputs of a score. Scoring is one pass without a shuffle.

Defined cases: null or empty text has no terms and gets the intercept's score; a null id is not held out; a label
row that occurs again counts once, toxic winning; without labels of both kinds every score is the known share
of toxic rows (0 without any).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import common

MOST_TRAINING_DOCS, FACTORS = 4000, 4
#: Penalties that are tried, in training rows: what so many rows or fewer hold has no weight.
SUPPORTS = (16, 10, 6, 4)
MARKS = ".,;:!?\"'()[]{}<>*#%&$|-_…«»„“”"
_MASK = (1 << 22) - 1
#: Letters of a word's beginnings that are terms of their own.
STEMS = (4, 6)


def word_terms(word: str) -> tuple[int, ...]:
    word = word.strip(MARKS)
    if not word:
        return ()
    return tuple({zlib.crc32(b"w" + word.encode()) & _MASK, *(zlib.crc32(b"%d" % n + word[:n].encode()) & _MASK for n in STEMS if len(word) >= n)})


class Terms:
    """The terms of texts; remembers those of the words it met last. Only terms of `known` count, if given."""

    def __init__(self, known: dict[int, int] | None = None, most: int = 300_000) -> None:
        self.known, self.most, self.memo = known, most, {}

    def _of(self, word: str) -> tuple[int, ...]:
        terms = word_terms(word)
        if self.known is not None:
            terms = tuple(self.known[t] for t in terms if t in self.known)
        if len(self.memo) >= self.most:
            self.memo.clear()
        if len(word) <= 40:
            self.memo[word] = terms
        return terms

    def __call__(self, text: str | None) -> dict[int, float]:
        out, get = {}, self.memo.get
        for word, n in Counter((text or "").lower().split()).items():
            terms = get(word)
            if terms is None:
                terms = self._of(word)
            for t in terms:
                out[t] = out.get(t, 0) + n
        return {t: 1 + math.log(n) for t, n in out.items()}


class _Rows:
    """Terms of texts, as places, columns and values; only terms that more than `least` rows hold."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], least: float) -> None:
        n = np.zeros(_MASK + 1, np.int32)
        for r, _ in rows:
            n[r] += 1
        self.terms = np.flatnonzero(n > least)
        column = np.full(_MASK + 1, -1, np.int32)
        column[self.terms] = np.arange(len(self.terms))
        known = [(column[r], x) for r, x in rows]
        known = [(c[c >= 0], x[c >= 0]) for c, x in known]
        none = np.zeros(0, np.float32)
        self._set(np.concatenate([none.astype(np.int32), *(c for c, _ in known)]), np.concatenate([none, *(x for _, x in known)]), np.array([len(c) for c, _ in known]))

    def _set(self, cols: np.ndarray, values: np.ndarray, counts: np.ndarray) -> None:
        self.cols, self.values, self.counts, self.ends = cols, values, counts, np.cumsum(counts)

    def only(self, some: np.ndarray) -> _Rows:
        """The rows of a mask, with the same columns."""
        out = object.__new__(_Rows)
        out.terms = self.terms
        each = np.repeat(some, self.counts)
        out._set(self.cols[each], self.values[each], self.counts[some])
        return out

    def among(self, some: np.ndarray) -> _Rows:
        """All rows, with the columns of a mask."""
        out = object.__new__(_Rows)
        out.terms = self.terms[some]
        has, column = some[self.cols], np.cumsum(some) - 1
        out._set(column[self.cols[has]], self.values[has], np.diff(np.append(0, np.append(0, np.cumsum(has))[self.ends])))
        return out

    def sums(self, u: np.ndarray, power: int = 1) -> np.ndarray:
        """Of each row, the sum of u times value over its terms."""
        total = np.append(0.0, np.cumsum(u[self.cols] * self.values**power))
        return total[self.ends] - total[self.ends - self.counts]

    def spread(self, e: np.ndarray, power: int = 1) -> np.ndarray:
        """Of each term, the sum of e times value over its rows."""
        return np.bincount(self.cols, np.repeat(e, self.counts) * self.values**power, len(self.terms))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descent(x: _Rows, y: np.ndarray, penalty: float, w0: float, w: np.ndarray, offset: np.ndarray | float, rounds: int) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on w, by accelerated proximal gradient from (w0, w); offset: what else a row scores.
    Each term has a step of its own, from a bound of the curvature by the lengths of its rows."""
    size = 1 + x.sums(np.ones(len(w)))
    step, step0 = 4 * len(y) / np.maximum(x.spread(size), 1), 4 * len(y) / size.sum()
    a0, a, t = w0, w, 1.0
    for _ in range(rounds):
        e = _sigmoid(a0 + x.sums(a) + offset) - y
        new0, new = a0 - step0 * e.sum() / len(y), a - step * x.spread(e) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        if (new0 - w0) * (a0 - new0) + (new - w) @ (a - new) > 0:  # it overshot
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = max(abs(new0 - w0), np.abs(new - w).max(initial=0.0))
        a0, a = new0 + (t - 1) / after * (new0 - w0), new + (t - 1) / after * (new - w)
        w0, w, t = new0, new, after
        if moved < 5e-4:
            break
    return w0, w


def _weights(x: _Rows, y: np.ndarray, penalty: float, w0: float, w: np.ndarray, offset: np.ndarray | float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """The weights under the penalty. Most are 0: it works on those that aren't or whose slope exceeds the penalty, until no other term's does."""
    w = w.copy()
    some = w != 0
    for _ in range(30):
        slope = x.spread(_sigmoid(w0 + x.sums(w) + offset) - y) / len(y)
        more = ~some & (np.abs(slope) > penalty * 1.001)
        if some.any() and not more.any():
            break
        some |= more
        w0, w[some] = _descent(x.among(some), y, penalty, w0, w[some], offset, rounds)
        if not some.any():
            break
    return w0, w


def _relaxed(x: _Rows, y: np.ndarray, penalty: float, w0: float, w: np.ndarray, offset: np.ndarray) -> tuple[float, np.ndarray]:
    """Weights of the terms that the penalty left, fitted again with a tenth of it, as it makes all of them too small."""
    some = w != 0
    new = np.zeros(len(w))
    w0, new[some] = _descent(x.among(some), y, penalty / 10, w0, w[some], offset, 300)
    return w0, new


def _pairs(x: _Rows, v: np.ndarray) -> np.ndarray:
    """Of each row, the sum over pairs of its terms, by their number."""
    sums = np.stack([x.sums(v[:, k]) for k in range(v.shape[1])], 1)
    return 0.5 * ((sums**2).sum(1) - x.sums((v**2).sum(1), 2)) / np.maximum(x.counts, 1)


def _factors(x: _Rows, y: np.ndarray, score: np.ndarray, factors: int, rounds: int) -> np.ndarray:
    """Factors of pairs beside a given score, by Adam; those that the penalty takes to 0 are 0."""
    v = np.random.default_rng(7).normal(0, 0.2, (len(x.terms), factors))
    m, s = np.zeros_like(v), np.zeros_like(v)
    scale = 1 / np.maximum(x.counts, 1)
    for step in range(1, rounds + 1):
        e = (_sigmoid(score + _pairs(x, v)) - y) * scale
        alone = x.spread(e, 2)
        g = np.stack([x.spread(e * x.sums(v[:, k])) for k in range(factors)], 1) - alone[:, None] * v + 2 * v
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g**2
        v = v - 0.1 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        if step >= 10 and np.abs(v).max(initial=0.0) < 0.02:  # nothing in pairs
            return np.zeros_like(v)
    return np.where((np.abs(v).max(1) > 0.05)[:, None], v, 0.0)


class FactorizationMachine:
    """terms: numbers that have a weight or factors; w0, w, v: intercept, weights, factors."""

    def __init__(self, terms: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.terms, self.w0, self.w, self.v = terms, w0, w, v
        self.squares, self.paired = (v**2).sum(axis=1), v.any(axis=1)

    @classmethod
    def trained(cls, texts: list[str | None], labels: list[int], share: float, factors: int = FACTORS, rounds: int = 60) -> FactorizationMachine:
        """share: of label 1 among all rows that could have been drawn; moves the intercept."""
        y = np.array(labels, float)
        none = cls(np.zeros(0, np.int64), float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(0), np.zeros((0, factors)))
        if len(set(labels)) < 2:
            return none
        of = Terms(most=50_000)
        rows = [(np.fromiter(found, np.int32), np.fromiter(found.values(), np.float32)) for found in map(of, texts)]  # as arrays, for the driver's memory
        n = len(y)
        # the smallest penalty that is tried lets through no term of fewer rows
        x = _Rows(rows, min(SUPPORTS) * min(1.0, n / 1000))
        del rows, of
        penalties = [k * min(1.0, n / 1000) / n for k in SUPPORTS]
        fold = np.arange(n) % 4 == 3
        fit, seen, test, asked = x.only(~fold), y[~fold], x.only(fold), y[fold]
        best, loss = penalties[0], np.inf
        w0, w = 0.0, np.zeros(len(x.terms))
        for penalty in penalties:
            w0, w = _weights(fit, seen, penalty, w0, w, 0.0)
            z0, z = _relaxed(fit, seen, penalty, w0, w, 0.0)
            z = z0 + test.sums(z)
            now = float((np.logaddexp(0, z) - asked * z).sum())
            if now < loss:
                best, loss = penalty, now
        w0, w = _weights(x, y, best, 0.0, np.zeros(len(x.terms)), 0.0)
        # what the penalty keeps the weights from telling is left for pairs; then the weights are fitted beside these
        held = np.bincount(x.cols, minlength=len(x.terms)) > best * n
        v = np.zeros((len(x.terms), factors))
        v[held] = _factors(x.among(held), y, w0 + x.sums(w), factors, rounds)
        some = v.any(1)
        w0, w = _relaxed(x, y, best, w0, w, _pairs(x.among(some), v[some]))
        keep = (w != 0) | some
        drawn = y.mean()
        shift = np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(drawn / (1 - drawn))
        return cls(x.terms[keep], float(w0 + shift), w[keep], v[keep])

    def score(self, terms: dict[int, float]) -> float:
        """terms: places in self.terms, and values."""
        z = self.w0
        if terms:
            i = sorted(terms)
            x = np.array([terms[t] for t in i])
            z += (self.w[i] * x).sum()
            if n := int(self.paired[i].sum()):
                z += 0.5 * (((self.v[i] * x[:, None]).sum(axis=0) ** 2).sum() - (self.squares[i] * x**2).sum()) / n
        return float(_sigmoid(np.float64(z)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING_DOCS) -> FactorizationMachine:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    # at most `most` rows, so that the join below may broadcast them
    half = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for k in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(half[0].unionByName(half[1])), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return FactorizationMachine.trained([r.text for r in rows], [r.toxic for r in rows], float(share))


def toxicity_scores(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, score, predicted): a row for each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms({t: i for i, t in enumerate(model.terms.tolist())})
        for b in common.steps(batches):
            scores = [model.score(terms(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["id", "score", "predicted"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = toxicity_scores(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
