"""Quality rules (8): counting rules first, then a linear-chain conditional random field over lines.

Each line of a text is described by a few numbers (letters in capitals, symbols, digits, other marks, words,
their length, repeats). A linear-chain CRF with the labels content and boilerplate, decoded by Viterbi, marks
the lines; a document is kept if lines marked as content hold at least a certain share of its characters in
words.

Training: the table `labels` tells documents apart, not lines, so the labels of lines are latent. A document of quality 1 has
content lines that hold at least SHARE of its characters in words, one of quality 0 less than that; any line of either may be
of either kind. It starts from a model of single lines that takes each document's label for its lines; from then on, lines are
labelled by the model (and, where a document breaks its rule, its least certain lines are turned until it holds), and the CRF is fitted to
these label sequences by gradient ascent on their likelihood. So it learns from pages of mixed lines where content and boilerplate
follow one another. The share from which documents are kept is learnt too: it is the one that tells most training documents apart.
Training takes at most `most` labelled documents (chosen by a hash of the id; of an id that occurs again, its smallest text) and sees their whole
texts; nothing else is bounded.

Defined cases: null or empty text has no words and fails the base rules; without labels of both kinds the CRF
marks everything as content; a label row that is null or occurs again counts once, quality 0 winning; other
columns, whatever their names, pass through filter_by_quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import common
from leafmark.llm.words import Words, covered

CONTENT, BOILERPLATE = 0, 1
#: Of a document of quality 1, the least share of characters in words that content lines hold; one of quality 0 has less.
SHARE = 0.7
SYMBOLS = b"#*$%&|<>"
MOST_TRAINING_DOCS = 3000
STEP = 4 << 20
_CLASS = np.zeros(256, np.uint8)  # bits: 1 symbol, 2 capital, 4 small, 8 digit, 16 other mark
_CLASS[list(range(33, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 127))] = 16
_CLASS[list(SYMBOLS)] = 1
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[0xC3:0xF5] = 2, 4, 8, 4


def _sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=total[1:], dtype=np.int32)
    return (total[ends] - total[starts]).astype(np.int64)


class Lines:
    """Counts and features of the lines of many texts."""

    def __init__(self, column: pa.Array) -> None:
        w = self.words = Words(column)
        b, bounds = w.bytes, w.bounds
        breaks = np.flatnonzero(b == 10)
        starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([bounds[1:], breaks]), kind="stable")
        of_row = np.bincount(np.searchsorted(bounds, breaks, "right") - 1, minlength=len(bounds) - 1) + 1
        self.row, self.of_row = np.repeat(np.arange(len(bounds) - 1), of_row), of_row
        self.starts, self.ends = starts, ends
        begin = np.zeros(len(b), bool)
        begin[w.starts] = True
        point = (b & 0xC0) != 0x80
        self.n_words, self.chars = _sums(begin, starts, ends), _sums(point & ~w.space, starts, ends)
        kinds = _CLASS[b]
        accent = np.zeros(len(b), bool)  # capitals of Latin-1
        accent[:-1] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
        kinds[accent] = 2
        self.symbols, upper, small, digit, mark = (_sums(kinds == k, starts, ends) for k in (1, 2, 4, 8, 16))
        self.again = self._again(column)
        same = np.zeros(len(b), bool)  # words equal to the word before
        same[w.starts[1:][w.hash[1:] == w.hash[:-1]]] = True
        stutter = _sums(same, starts, ends) / np.maximum(self.n_words, 1)
        n = np.maximum(self.chars, 1)
        self.features = np.column_stack([
            np.ones(len(starts)), np.minimum(np.log1p(self.n_words), 5) / 5, np.minimum(self.chars / np.maximum(self.n_words, 1), 20) / 20,
            upper / np.maximum(upper + small, 1), np.minimum(4 * self.symbols / n, 1), np.minimum(2 * digit / n, 1),
            np.minimum(4 * mark / n, 1), self.again, self.n_words == 0, upper > small, 8 * self.symbols > n, stutter, stutter > 0.3,
        ]).astype(np.float64)

    def _again(self, column: pa.Array) -> np.ndarray:
        """Lines with a word, equal to an earlier line of the text."""
        lines = pc.split_pattern(pc.fill_null(column, "").cast(pa.large_string()), "\n").flatten()
        key = self.row.astype(np.int64) << 32 | lines.dictionary_encode().indices.to_numpy()
        some = np.flatnonzero(self.n_words)
        order = some[np.argsort(key[some], kind="stable")]
        out = np.zeros(len(key), bool)
        out[order[1:][key[order[1:]] == key[order[:-1]]]] = True
        return out

    def by_row(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x, len(self.of_row)).astype(np.int64)

    def repeated_words(self, k: int = 8) -> np.ndarray:
        """Of each text, the words in k-word windows that occur twice or more in it."""
        h, one = self.words.windows(k)
        at = np.flatnonzero(one)
        order = at[np.lexsort((h[at], self.words.row[at]))]
        same = (h[order[1:]] == h[order[:-1]]) & (self.words.row[order[1:]] == self.words.row[order[:-1]])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        words = covered(order[twice], k, len(self.words.starts))
        return np.bincount(self.words.row[words], minlength=len(self.of_row))


def _share(content: np.ndarray, chars: np.ndarray, of_row: np.ndarray) -> np.ndarray:
    """Of each text, the share of its characters that lines of content hold."""
    row = np.repeat(np.arange(len(of_row)), of_row)
    return np.bincount(row, chars * content, len(of_row)) / np.maximum(np.bincount(row, chars, len(of_row)), 1)


class LineCrf:
    """weights: features x labels; moves: label to label. Scores are sums of both along the lines. least_share: documents with
    less content go."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, least_share: float = 0.5) -> None:
        self.weights, self.moves, self.least_share = weights, moves, least_share

    @classmethod
    def trained(cls, features: np.ndarray, of_row: np.ndarray, chars: np.ndarray, good: np.ndarray, cycles: int = 3, rounds: int = 80) -> LineCrf | None:
        """features, chars (in words): of all lines; of_row: lines of each document; good: its label."""
        if len(set(good.tolist())) < 2:
            return None
        row = np.repeat(np.arange(len(of_row)), of_row)
        parts = _Parts(features, of_row)
        model = parts.fitted(cls(np.zeros((features.shape[1], 2)), np.zeros((2, 2))), np.where(good[row], CONTENT, BOILERPLATE), rounds, chained=False)
        for _ in range(cycles):
            marked = model.viterbi(features, of_row)
            gain = features @ model.weights
            marked = _allowed(marked, gain[:, CONTENT] - gain[:, BOILERPLATE], chars, of_row, good)
            model = parts.fitted(model, marked, rounds)
        share = _share(model.viterbi(features, of_row) == CONTENT, chars, of_row)
        cuts = np.unique(np.append(share, 0.5))
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        right = [((share >= c) & good).sum() / good.sum() + ((share < c) & ~good).sum() / (~good).sum() for c in cuts]
        best = cuts[np.isclose(right, max(right))]
        model.least_share = float(best[np.argmin(np.abs(best - 0.5))])
        return model

    def viterbi(self, features: np.ndarray, of_row: np.ndarray) -> np.ndarray:
        """The best labels of many sequences after one another, a line of each at a time; of equal ones, content."""
        gain = features @ self.weights
        ends = np.cumsum(of_row)
        order = np.argsort(-of_row, kind="stable")
        start, n = (ends - of_row)[order], of_row[order]
        n = n[n > 0]
        start, t = start[: len(n)], self.moves
        out, back = np.zeros(len(gain), np.int8), np.zeros((len(gain), 2), np.int8)
        best = gain[start]
        more = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")  # sequences longer than so many lines
        for i in range(1, len(more)):
            m = more[i]
            at, old = start[:m] + i, best[:m]
            for k in (0, 1):
                a, b = old[:, 0] + t[0, k], old[:, 1] + t[1, k]
                back[at, k] = b > a
                best[:m, k] = np.maximum(a, b) + gain[at, k] if k else best[:m, k]
                if not k:
                    first = np.maximum(a, b) + gain[at, 0]
            best[:m, 0] = first
        label = (best[:, 1] > best[:, 0]).astype(np.int8)
        for i in range(len(more) - 1, -1, -1):
            m = more[i]
            at = start[:m] + i
            out[at] = label[:m]
            label[:m] = back[at, label[:m]]
        return out


class _Parts:
    """Sequences cut to pieces of a few lines, which share rounds."""

    def __init__(self, features: np.ndarray, of_row: np.ndarray, piece: int = 24) -> None:
        ends = np.cumsum(of_row)
        cuts = [(i, min(i + piece, z)) for a, z in zip(ends - of_row, ends, strict=True) for i in range(a, z, piece)]
        self.size = max(z - a for a, z in cuts)
        self.at = np.array([a for a, _ in cuts])[:, None] + np.arange(self.size)
        self.here = (np.arange(self.size) < np.array([z - a for a, z in cuts])[:, None]).astype(float)
        self.at[self.here == 0] = 0
        self.x = features[self.at] * self.here[:, :, None]
        self.weigh = 1 / (self.here.sum(1) * len(cuts))  # a sequence counts once, however long

    def fitted(self, crf: LineCrf, labels: np.ndarray, rounds: int, chained: bool = True, decay: float = 1e-4) -> LineCrf:
        """Adam on the mean log-likelihood of the labels, with L2, from crf on. Not chained: lines on their own."""
        x, here, size, weigh = self.x, self.here, self.size, self.weigh
        have = np.eye(2)[labels[self.at]] * here[:, :, None]
        theta = np.concatenate([crf.weights.ravel(), crf.moves.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        pair = weigh[:, None, None, None] * have[:, :-1, :, None] * have[:, 1:, None, :]
        for step in range(1, rounds + 1):
            w, t = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
            s = x @ w
            a, z = np.zeros_like(s), np.zeros_like(s)
            a[:, 0] = s[:, 0]
            for k in range(1, size):
                a[:, k] = np.logaddexp(a[:, k - 1, :1] + t[0], a[:, k - 1, 1:] + t[1]) + s[:, k]
                a[:, k] = np.where(here[:, k, None] > 0, a[:, k], a[:, k - 1])
            for k in range(size - 2, -1, -1):
                ahead = (s[:, k + 1] + z[:, k + 1])[:, None, :] + t
                z[:, k] = np.where(here[:, k + 1, None] > 0, np.logaddexp(ahead[:, :, 0], ahead[:, :, 1]), 0)
            total = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
            p = np.exp(a + z - total[:, None, None]) * here[:, :, None]
            grad_w = np.einsum("n,nkf,nkl->fl", weigh, x, have - p)
            grad_t = np.zeros((2, 2))
            if chained:
                pairs = np.exp(a[:, :-1, :, None] + t + (s[:, 1:] + z[:, 1:])[:, :, None, :] - total[:, None, None, None]) * here[:, 1:, None, None]
                grad_t = pair.sum((0, 1)) - np.einsum("n,nklm->lm", weigh, pairs)
            grad = np.concatenate([grad_w.ravel(), grad_t.ravel()]) - decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return LineCrf(theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


def _allowed(marked: np.ndarray, margin: np.ndarray, chars: np.ndarray, of_row: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The labels of lines, the least certain turned in documents whose share of content is not that of their own label."""
    marked, share, ends = marked.copy(), _share(marked == CONTENT, chars, of_row), np.cumsum(of_row)
    for i in np.flatnonzero((share >= SHARE) != good):
        lines = np.arange(ends[i] - of_row[i], ends[i])
        sign = -1 if good[i] else 1
        total, content = max(chars[lines].sum(), 1), chars[lines][marked[lines] == CONTENT].sum()
        for k in lines[np.argsort(sign * margin[lines], kind="stable")]:
            if (content >= SHARE * total) == good[i]:
                break
            if good[i] and marked[k] == BOILERPLATE:
                marked[k], content = CONTENT, content + chars[k]
            elif not good[i] and marked[k] == CONTENT:
                marked[k], content = BOILERPLATE, content - chars[k]
    return marked


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING_DOCS) -> LineCrf | None:
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # at most `most` rows, half of each kind, so that the join below may broadcast them
    half = [known.filter(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for k in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(half[0].unionByName(half[1])), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).orderBy("doc_id").collect()
    if not rows:
        return None
    lines = Lines(pa.array([r.text for r in rows], pa.string()))
    return LineCrf.trained(lines.features, lines.of_row, lines.chars, np.array([bool(r.quality) for r in rows]))


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def _judged(crf: LineCrf | None, least_share: float | None):
    least = (crf.least_share if crf else 0.0) if least_share is None else least_share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches, STEP, "__text"):
            lines = Lines(b.column(b.schema.get_field_index("__text")))
            n, chars = lines.by_row(lines.n_words), lines.by_row(lines.chars)
            repeat = lines.repeated_words()
            failed = (n < 20) | (100 * repeat > 30 * n)
            marked = crf.viterbi(lines.features, lines.of_row) if crf else np.zeros(len(lines.row), np.int8)
            share = _share(marked == CONTENT, lines.chars, lines.of_row)
            new = [n, chars, lines.by_row(lines.symbols), lines.by_row(lines.again), repeat, share, failed, ~failed & (share >= least)]
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(x) for x in new], b.schema.names + ["__" + x.split()[0] for x in COUNTS.split(", ")])

    return run


def _with_verdicts(named: DataFrame, names: list[str], types: list[str], text: str, crf: LineCrf | None, least_share: float | None) -> DataFrame:
    common.small_batches(named.sparkSession)
    rows = named.select(*names, F.col(text).alias("__text"))
    schema = ", ".join([f"{c} {t}" for c, t in zip(names, types, strict=True)] + ["__text string"] + ["__" + x for x in COUNTS.split(", ")])
    return rows.mapInArrow(_judged(crf, least_share), schema)


def quality_verdicts(docs: DataFrame, crf: LineCrf | None, id_col: str = "doc_id", text_col: str = "text", least_share: float | None = None) -> DataFrame:
    """(id column, counts, content_share, base_failed, kept): a row for each document. least_share: another than the learnt one."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1"))
    out = _with_verdicts(slim, ["c0"], [kind], "c1", crf, least_share)
    return out.select(F.col("c0").alias(id_col), *[F.col("__" + x.split()[0]).alias(x.split()[0]) for x in COUNTS.split(", ")])


def filter_by_quality(docs: DataFrame, crf: LineCrf | None, text_col: str = "text", least_share: float | None = None) -> DataFrame:
    """The documents that are kept, with the columns of docs."""
    named, names, types = common.inner(docs)
    out = _with_verdicts(named, names, types, names[docs.columns.index(text_col)], crf, least_share)
    return out.filter("__kept").select(*[F.col(c).alias(name) for c, name in zip(names, docs.columns, strict=True)])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality_verdicts(docs, train(docs, common.table(spark, sf_dir, "labels")))
