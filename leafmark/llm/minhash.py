"""MinHash near-dedup (3): improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A text's shingles are its windows of five words (a shorter text is one shingle). A shingle weighs
(1 + ln tf) * (1 + ln((N + 1) / (df + 1)) / (4 ln(N + 2))). Its df is counted exactly over all documents, by its 64-bit hash:
the hashes of a step of texts are dealt by their top bits to PARTS groups that count them, and what comes back to each text
are its shingles that other texts have too; the rest have a df of 1. No table of shingles goes to the driver or to all tasks. Improved consistent weighted sampling (Ioffe 2010) draws `2 * bands`
samples from each text, equal for two texts with the probability of their weighted Jaccard similarity; two samples are
a band. Texts with an equal band are candidates, and a pair is a link if its weighted Jaccard similarity,
from the full shingle sets, is at least `threshold`. At 0.8, ten bands of two miss a link with
probability (1 - 0.64) ** 10 = 4e-5. Classes are connected components over links, named by their smallest id.

No pairs within a group: rows of one text are one node from the start (nodes are distinct texts, by 128 bits). In a bucket, each text is verified against
the bucket's smallest one, which already joins most. Where more than SPOKESMEN texts are then outside the bucket's largest component, one of each of so many components are
held against the whole bucket, which joins groups of copies whose pairs are links in part. What is still in several components is
finished exactly, by holding the texts outside the largest component against all of the bucket, in blocks that are
spread over tasks; only links that join two components come out, and pairs that share a component are never looked at. Where that would be more than BLOCK texts against as
many (very many texts that are alike but no copies), the bucket is first cut by prefixes: in order of df, the rarest shingles of a text that
hold more than 1 - `threshold` of its weight; two texts at the threshold share a shingle of these (what they share weighs at least
`threshold` of either, and without one all of it would lie in the rest of that text whose prefix ends first). So texts that have
a prefix shingle in common are a bucket of their own, texts that only share frequent shingles part, and what is mixed there is finished.

Skew: copies never reach the buckets; a bucket's smallest id is found by a partial aggregation, and the joins back to
its members are joins that Spark can split. Joins carry 64 bits for each shingle (low bits and df) and only texts that are in a pair.

Range of the IDF: weights bend similarity. Were they the plain logarithm, a changed word of a text with very many near copies would weigh several times what they
share, and copies that share nine tenths of their shingles would fall below the threshold. IDF_SHARE bounds the ratio of the largest and smallest weight; README has figures.

Defined cases: texts without words are in no class but their own; null ids are one document; rows that repeat an id are one
document, which joins the classes of its texts; an empty table gives an empty result; other columns, whatever their names, pass through keep_one_of_each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import common
from leafmark.llm.components import components
from leafmark.llm.words import Words, mix

SHINGLE, THRESHOLD, BANDS = 5, 0.8, 10
IDF_SHARE = 0.25  # a shingle of one document weighs so much more than one that all have
DRAWS = 1 << 16
PARTS = 1 << 10  # groups in which shingles are counted; each holds so small a part of all shingles at once
BLOCK = 384  # texts of a bucket that one task holds against as many
SPOKESMEN = 32  # texts of a mixed bucket, of as many components, that are held against all of it first
STEP = 3 << 20
_TABLES: dict[int, tuple] = {}


def _tables(n: int) -> tuple[np.ndarray, ...]:
    """Draws for n samples: r (and 1/r), beta and ln c, each by 16 other bits of a shingle's hash, so that two shingles have the same three with
    a probability of 2**-48; and the multipliers that pick the bits."""
    if n not in _TABLES:
        rng = np.random.default_rng(20100910)
        r, c = rng.gamma(2, 1, (n, DRAWS)), rng.gamma(2, 1, (n, DRAWS))
        beta = rng.random((n, DRAWS))
        odd = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _TABLES[n] = (*(x.astype(np.float32) for x in (r, 1 / r, beta, np.log(c))), odd)
    return _TABLES[n]


class Shingles:
    """Distinct shingles of many texts: row, hash, tf, in order of row and hash; the low 32 bits tell them apart."""

    def __init__(self, column: pa.Array, k: int = SHINGLE) -> None:
        w = self.words = Words(column)
        h, one = w.windows(k)
        h, row = h[one], w.row[: len(one)][one]
        base = np.cumsum(w.counts) - w.counts
        short = np.flatnonzero((w.counts > 0) & (w.counts < k))
        if len(short):
            own = [xxhash.xxh64_intdigest(w.hash[base[i] : base[i] + w.counts[i]].tobytes()) for i in short]
            h, row = np.append(h, np.array(own, np.uint64)), np.append(row, short)
        low = h.astype(np.uint32)
        order = np.lexsort((low, row))
        h, row, low = h[order], row[order], low[order]
        new = np.append(True, (row[1:] != row[:-1]) | (low[1:] != low[:-1])) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.hash, self.row, self.low = h[first], row[first], low[first]
        self.tf = np.diff(np.append(first, len(h)))
        self.counts = np.bincount(self.row, minlength=len(w.counts))

    def df(self, known: pa.Array) -> np.ndarray:
        """Of each shingle; known: for each text the packed (low, df) of its shingles that aren't its own alone."""
        df = np.ones(len(self.low), np.uint32)
        row, packed = [], []
        for i, some in enumerate(known.to_pylist()):
            for x in some or ():
                packed.append(np.frombuffer(x, np.uint32).reshape(2, -1))
                row.append(np.full(packed[-1].shape[1], i, np.uint64))
        if packed:
            low, n = np.concatenate(packed, 1)
            key, first = np.unique(np.concatenate(row) << np.uint64(32) | low, return_index=True)
            mine = self.row.astype(np.uint64) << np.uint64(32) | self.low
            at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            same = key[at] == mine
            df[same] = n[first[at[same]]]
        return df

    def weights(self, idf: np.ndarray) -> np.ndarray:
        return ((1 + np.log(self.tf)) * idf).astype(np.float32)


def samples(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """n samples (64-bit numbers) of each text that has shingles; counts: of shingles, none 0."""
    r, inverse, beta, ln_c, odd = _tables(n)
    ends = np.cumsum(counts)
    starts = ends - counts
    ln_w = np.log(weights)
    out = np.empty((len(counts), n), np.uint64)
    for k in range(n):
        spread = hashes * odd[k]
        i, j, m = (((spread >> np.uint64(bits)) & np.uint64(DRAWS - 1)).astype(np.intp) for bits in (48, 32, 16))
        b = beta[k][j]
        t = np.floor(ln_w * inverse[k][i] + b)
        a = ln_c[k][m] - r[k][i] * (t - b + 1)
        at = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), counts))
        at = at[np.searchsorted(at, starts)]  # of equals the first, which has the smallest low bits
        out[:, k] = mix(hashes[at] ^ mix(t[at].astype(np.int64).astype(np.uint64) + np.uint64(k)))
    return out


def idf_of(df: np.ndarray, docs: int) -> np.ndarray:
    return (1 + IDF_SHARE * np.log((docs + 1) / (df + 1.0)) / np.log(docs + 2)).astype(np.float32)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of a step, a row for each part: hashes and the texts that have them; the first row has the texts' keys."""
    for b in common.gathered(batches, STEP):
        s = Shingles(b.column(b.schema.get_field_index("text")))
        if not len(s.hash):
            continue
        part = (s.hash >> np.uint64(54)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, hashes = part[order], s.hash[order]
        doc = s.row[order].astype(np.uint16 if len(s.counts) < 1 << 16 else np.uint32)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(first[1:], len(part))
        keys = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in ("id", "t1", "t2")]).tobytes()
        step = xxhash.xxh3_64_intdigest(keys + s.hash.tobytes()) >> 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part[first], pa.int32()), pa.array(np.full(len(first), step), pa.int64()),
                pa.array([hashes[x:z].tobytes() for x, z in zip(first, ends, strict=True)], pa.binary()),
                pa.array([doc[x:z].tobytes() for x, z in zip(first, ends, strict=True)], pa.binary()),
                pa.array([keys] + [None] * (len(first) - 1), pa.binary()), pa.array([int((s.counts > 0).sum())] + [0] * (len(first) - 1), pa.int64()),
            ],
            ["part", "step", "hash", "doc", "keys", "n"],
        )


def _counted(asked: pa.Table) -> pa.Table:
    """Of a part: for each step, its shingles that more than one text has, with their df."""
    hashes, docs = asked.column("hash").to_pylist(), asked.column("doc").to_pylist()
    each = np.frombuffer(b"".join(hashes), np.uint64)
    _, which, n = np.unique(each, return_inverse=True, return_counts=True)
    df, at = n[which].astype(np.uint32), 0
    low, found, owner = [], [], []
    for h, d in zip(hashes, docs, strict=True):
        end = at + len(h) // 8
        more = df[at:end] > 1
        low.append(each[at:end][more].astype(np.uint32).tobytes())
        found.append(df[at:end][more].tobytes())
        owner.append(np.frombuffer(d, f"u{8 * len(d) // len(h)}")[more].astype(np.uint32).tobytes())
        at = end
    out = pa.table({"step": asked.column("step"), "low": pa.array(low, pa.binary()), "df": pa.array(found, pa.binary()), "doc": pa.array(owner, pa.binary()), "keys": asked.column("keys"), "n": asked.column("n")})
    return out.filter(pc.or_(pc.greater(pc.binary_length(out["low"]), 0), pc.is_valid(out["keys"])))


def _answered(replies: pa.Table) -> pa.Table:
    """Of a step: for each text the packed (low, df) of its shared shingles; and a row with the number of texts."""
    keys = np.frombuffer(next(x for x in replies.column("keys").to_pylist() if x is not None), np.int64).reshape(3, -1)
    doc, low, df = (np.frombuffer(b"".join(replies.column(c).to_pylist()), np.uint32) for c in ("doc", "low", "df"))
    key, first = np.unique(doc.astype(np.uint64) << np.uint64(32) | low, return_index=True)
    doc, pairs = (key >> np.uint64(32)).astype(np.int64), np.stack([low[first], df[first]])
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    known = [pairs[:, x:z].tobytes() for x, z in zip(starts, np.append(starts, len(doc))[1:], strict=True)]
    some = doc[starts]
    return pa.table(
        {
            **{c: pa.array([*k[some].tolist(), None], pa.int64()) for c, k in zip(("id", "t1", "t2"), keys, strict=True)},
            "known": pa.array([*known, None], pa.binary()), "n": pa.array([0] * len(some) + [sum(replies.column("n").to_pylist())], pa.int64()),
        }
    )


def _tagged(rows: DataFrame) -> DataFrame:
    t1, t2 = common.tags("text")
    return rows.select("id", t1.alias("t1"), t2.alias("t2"), "text")


def shared_shingles(rows: DataFrame) -> tuple[DataFrame, int]:
    """(id, t1, t2, known) of the texts that share shingles with others; the number of texts that have any."""
    asked = _tagged(rows).mapInArrow(_asked, "part int, step long, hash binary, doc binary, keys binary, n long")
    replies = asked.groupBy("part").applyInArrow(_counted, "step long, low binary, df binary, doc binary, keys binary, n long")
    found = common.written(replies.groupBy("step").applyInArrow(_answered, "id long, t1 long, t2 long, known binary, n long"), "shared-shingles")
    return found.filter("known IS NOT NULL").select("id", "t1", "t2", "known"), found.agg(F.sum("n")).first()[0] or 0


def _with_known(rows: DataFrame, shared: DataFrame) -> DataFrame:
    shared = shared.groupBy("id", "t1", "t2").agg(F.collect_set("known").alias("known"))
    return _tagged(rows).join(shared, ["id", "t1", "t2"], "left").select("id", "text", "known")


class Idf:
    """IDF by the low bits of shingles, for tables whose shared shingles fit in memory."""

    def __init__(self, low: np.ndarray, df: np.ndarray, docs: int) -> None:
        order = np.lexsort((df, low))
        self.low, self.df, self.docs = low[order], df[order], docs

    def __getitem__(self, low: np.ndarray) -> np.ndarray:
        df = np.ones(len(low), np.uint32)
        at = np.searchsorted(self.low, low, "right") - 1
        same = at >= 0
        same[same] = self.low[at[same]] == low[same]
        df[same] = self.df[at[same]]
        return idf_of(df, self.docs)


def shingle_weights(rows: DataFrame) -> Idf:
    shared, docs = shared_shingles(rows)
    packed = [np.frombuffer(r.known, np.uint32).reshape(2, -1) for r in shared.select("known").collect()]
    low, df = np.concatenate([np.zeros((2, 0), np.uint32), *packed], 1)
    return Idf(low, df, docs)


def _signed(docs: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.gathered(batches, STEP):
            s = Shingles(b.column(b.schema.get_field_index("text")))
            some = np.flatnonzero(s.counts)
            if not len(some):
                continue
            drawn = samples(s.hash, s.weights(idf_of(s.df(b.column(b.schema.get_field_index("known"))), docs)), s.counts[some], n)
            bands = mix(drawn[:, ::2] + np.uint64(3) * mix(drawn[:, 1::2] + np.arange(n // 2, dtype=np.uint64))).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, n // 2), pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("node")).take(pa.array(some)), lists], ["node", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.steps(batches, STEP):
        s = Shingles(b.column(b.schema.get_field_index("text")))
        cuts = np.cumsum(s.counts)[:-1]
        low = [x.tobytes() for x in np.split(s.low, cuts)]
        tf, df = ([x.astype(np.uint32).tobytes() if (x > 1).any() else None for x in np.split(c, cuts)] for c in (s.tf, s.df(b.column(b.schema.get_field_index("known")))))
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("node")), pa.array(low, pa.binary()), pa.array(tf, pa.binary()), pa.array(df, pa.binary())], ["node", "low", "tf", "df"])


def _prefixes(docs: int, threshold: float):
    """(node, component, key): a row for each shingle of a text's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, of, keys = [], [], []
            for n, c, low, tf, df in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("node", "component", "low", "tf", "df")), strict=True):
                shingle = np.frombuffer(low, np.uint32)
                weight = _weights(_idf(low, df, docs), tf)
                order = np.lexsort((shingle, np.frombuffer(df, np.uint32) if df else np.ones(len(shingle), np.uint32)))
                left = weight.sum() - np.cumsum(weight[order])  # what is not in the prefix that ends here
                first = shingle[order][: int(np.argmax(left < threshold * weight.sum() * (1 - 1e-9))) + 1]
                keys.append(first.astype(np.int64)), node.append(np.full(len(first), n)), of.append(np.full(len(first), c))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (node, of, keys)], ["node", "component", "key"])

    return run


def _weights(idf: np.ndarray, tf: bytes | None) -> np.ndarray:
    return idf.astype(float) * (1 + np.log(np.frombuffer(tf, np.uint32))) if tf else idf.astype(float)


def _idf(low: bytes, df: bytes | None, docs: int) -> np.ndarray:
    return idf_of(np.frombuffer(df, np.uint32) if df else np.ones(len(low) // 4, np.uint32), docs)


def _similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    common_ = np.minimum(wa[same], wb[at[same]]).sum()
    return common_ / (wa.sum() + wb.sum() - common_)


def similarity(low_a: bytes, tf_a: bytes | None, low_b: bytes, tf_b: bytes | None, idf: Idf) -> float:
    a, b = np.frombuffer(low_a, np.uint32), np.frombuffer(low_b, np.uint32)
    return _similarity(a, _weights(idf[a], tf_a), b, _weights(idf[b], tf_b))


def _verified(docs: int, threshold: float):
    def close(low_a: bytes, tf_a: bytes | None, df_a: bytes | None, low_b: bytes, tf_b: bytes | None, df_b: bytes | None) -> bool:
        a, b = np.frombuffer(low_a, np.uint32), np.frombuffer(low_b, np.uint32)
        return _similarity(a, _weights(_idf(low_a, df_a, docs), tf_a), b, _weights(_idf(low_b, df_b, docs), tf_b)) >= threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [b.column(b.schema.get_field_index(x)).to_pylist() for x in ("low_a", "tf_a", "df_a", "low_b", "tf_b", "df_b")]
            ok = [bool(x[0] and x[3]) and close(*x) for x in zip(*c, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _joined(docs: int, threshold: float):
    """Of a block of a bucket: links from texts that aren't in its largest component to texts of other components, one
    for each two components that it joins. Exact: each similarity is computed from the full sets."""

    def run(asking: pa.Table, others: pa.Table) -> pa.Table:
        a, b = [], []
        if len(asking) and len(others):
            u_ids, u_of, u_sets = _unpacked(asking, docs)
            v_ids, v_of, v_sets = _unpacked(others, docs, "2")
            known = np.unique(np.concatenate([low for low, _ in u_sets]))
            owner = np.repeat(np.arange(len(v_sets)), [len(low) for low, _ in v_sets])
            low, weight = np.concatenate([x for x, _ in v_sets]), np.concatenate([w for _, w in v_sets])
            total = np.bincount(owner, weight, len(v_sets))
            at = np.minimum(np.searchsorted(known, low), len(known) - 1)
            same = known[at] == low
            owner, at, weight = owner[same], at[same], weight[same]
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            mine = np.zeros(len(known))
            for i, (low, w) in enumerate(u_sets):
                where = np.searchsorted(known, low)
                mine[where] = w
                inter = np.bincount(owner, np.minimum(mine[at], weight), len(v_sets))
                mine[where] = 0
                hit = np.flatnonzero((inter >= threshold * (w.sum() + total - inter)) & (v_of != u_of[i]))
                for j in hit[np.unique(v_of[hit], return_index=True)[1]]:
                    x, y = root(int(u_of[i])), root(int(v_of[j]))
                    if x != y:
                        parent[x] = y
                        a.append(u_ids[i]), b.append(v_ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _unpacked(t: pa.Table, docs: int, end: str = "") -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    each = zip(*[t.column(f"{c}{end}").to_pylist() for c in ("low", "tf", "df")], strict=True)
    sets = [(np.frombuffer(low, np.uint32), _weights(_idf(low, df, docs), tf)) for low, tf, df in each]
    return t.column(f"node{end}").to_numpy(), t.column(f"component{end}").to_numpy(), sets


class _Links:
    """Links between texts (nodes), found bucket by bucket. sets: (node, low, tf, df) of the texts in buckets."""

    def __init__(self, sets: DataFrame, docs: int, threshold: float) -> None:
        self.sets, self.docs, self.threshold = sets, docs, threshold
        self.classes = None

    def add(self, more: DataFrame) -> None:
        """classes: (id, component) after these links. Links of before are in their components by then."""
        known = self.classes.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more) if self.classes is not None else more
        self.classes = common.cut(components(known, "a", "b"))

    def to_leaders(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) that are links."""
        side = lambda x: self.sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("low", "tf", "df")])
        return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_verified(self.docs, self.threshold), "a long, b long")

    def placed(self, members: DataFrame) -> DataFrame:
        """members (key, node) with their components."""
        classes = self.classes.select(F.col("id").alias("node"), "component")
        return members.select("key", "node").join(classes, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))

    def mixed(self, placed: DataFrame, least: int = 3) -> DataFrame:
        """(key, largest, n, rest, parts) of the buckets of `least` texts or more that are in several components."""
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
        parts = parts.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("parts"))
        return parts.filter(f"n > most AND n >= {least}").select("key", "largest", "n", (F.col("n") - F.col("most")).alias("rest"), "parts")

    def spokesmen(self, placed: DataFrame, mixed: DataFrame) -> DataFrame:
        """(key, node): of each bucket, a text of each of about SPOKESMEN components beside the largest, drawn by a hash."""
        drawn = F.pmod(F.xxhash64("component"), F.ceil(F.col("parts") / F.lit(SPOKESMEN))) == 0
        return placed.join(mixed.select("key", "largest", "parts"), "key").filter(F.col("component") != F.col("largest")).filter(drawn).groupBy("key", "component").agg(F.min("node").alias("node")).select("key", "node")

    def finished(self, placed: DataFrame, mixed: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """Links between components of these buckets: what is outside the largest one (only: these few texts) held against all."""
        blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
        mixed = mixed if only is None else mixed.withColumn("rest", F.lit(1))
        inside = placed.join(mixed.select("key", "largest", blocks("rest").alias("nu"), blocks("n").alias("nv")), "key").join(self.sets, "node")
        block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asking = inside.filter("component <> largest") if only is None else inside.join(only, ["key", "node"], "left_semi")
        asking = asking.select("key", block("nu").alias("ub"), each("nv").alias("vb"), "node", "component", "low", "tf", "df")
        others = inside.select(each("nu").alias("ub2"), block("nv").alias("vb2"), *[F.col(c).alias(f"{c}2") for c in ("key", "node", "component", "low", "tf", "df")])
        return asking.groupBy("key", "ub", "vb").cogroup(others.groupBy("key2", "ub2", "vb2")).applyInArrow(_joined(self.docs, self.threshold), "a long, b long")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(id, class_id): a row for each id; ids without near duplicates are their own class."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(common.ident(id_col).alias("id"), F.col(text_col).alias("text"))
    shared, n_docs = shared_shingles(rows)
    key = ["id", "t1", "t2"]
    texts = _tagged(rows).select(*key)
    nodes = common.written(texts.groupBy("t1", "t2").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    known = shared.groupBy(*key).agg(F.first("known").alias("known"))

    def of(some: DataFrame) -> DataFrame:
        """(node, text, known) of these nodes; more than once where rows repeat."""
        some = some.join(known, key, "left").select(*key, "node", F.when(F.col("known").isNotNull(), F.array("known")).alias("known"))
        return _tagged(rows).join(some, key).select("node", "text", "known")

    one = lambda df: df.groupBy("node").agg(*[F.first(c).alias(c) for c in df.columns if c != "node"])
    signed = common.written(one(of(nodes).mapInArrow(_signed(n_docs, 2 * bands), "node long, bands array<long>")), "samples")
    in_band = signed.select("node", F.explode("bands").alias("key"))
    least = lambda df: df.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader")
    members = common.written(in_band.join(least(in_band), "key"), "bands")
    pairs = common.cut(members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = one(of(nodes.join(ends, "node", "left_semi")).mapInArrow(_sets, "node long, low binary, tf binary, df binary"))
    sets = common.written(sets, "shingles")
    links = _Links(sets, n_docs, threshold)
    links.add(links.to_leaders(pairs))

    placed = common.cut(links.placed(members))
    mixed = common.cut(links.mixed(placed))  # a pair in a bucket has been verified by now
    crowded = mixed.filter(F.col("rest") > SPOKESMEN)
    if not crowded.isEmpty():
        links.add(common.cut(links.finished(placed, crowded, links.spokesmen(placed, crowded))))
        placed = common.cut(links.placed(members))
        mixed = common.cut(links.mixed(placed))
    if not mixed.isEmpty():
        much = F.col("rest") * F.col("n") > BLOCK * BLOCK
        more = common.cut(links.finished(placed, mixed.filter(~much)))
        large = placed.join(mixed.filter(much).select("key"), "key", "left_semi").select("node", "component").distinct()
        if not large.isEmpty():
            cut = common.written(large.join(sets, "node").mapInArrow(_prefixes(n_docs, threshold), "node long, component long, key long"), "prefixes")
            more = more.unionByName(common.cut(links.finished(cut, links.mixed(cut, 2))))
        links.add(more)
    classes = links.classes

    worded = nodes.select("t1", "t2", "node").join(signed.select("node"), "node")
    of_text = texts.distinct().join(worded, ["t1", "t2"]).join(classes.select(F.col("id").alias("node"), "component"), "node", "left")
    of_text = common.cut(of_text.select("id", F.coalesce("component", "node").alias("component")).distinct())
    # a document of several texts joins their classes
    several = of_text.groupBy("id").agg(F.min("component").alias("a"), F.max("component").alias("z")).filter("a < z").select("id", "a")
    if not several.isEmpty():
        joined = components(of_text.join(several, "id").select("a", F.col("component").alias("b")), "a", "b").select(F.col("id").alias("component"), F.col("component").alias("whole"))
        of_text = of_text.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component")).distinct()
    smallest = of_text.groupBy("component").agg(F.min("id").alias("class_id"))
    classes = of_text.join(smallest, "component").select("id", "class_id")
    return texts.select("id").distinct().join(classes, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without near duplicates: of each class, the document with the smallest id stays."""
    gone = near_duplicate_classes(docs, id_col, text_col, threshold).filter("id <> class_id").select(F.col("id").alias("__id"))
    named, names, _ = common.inner(docs)
    rows = named.withColumn("__id", common.ident(names[docs.columns.index(id_col)]))
    return rows.join(common.cut(gone), "__id", "left_anti").select(*[F.col(c).alias(name) for c, name in zip(names, docs.columns, strict=True)])


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = near_duplicate_classes(docs)
    return docs.select("doc_id", common.ident("doc_id").alias("id")).join(classes, "id").select("doc_id", "class_id", (F.col("id") == F.col("class_id")).alias("kept"))
