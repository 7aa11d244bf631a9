"""Approximate nearest neighbours (6): multiprobe p-stable hashing.

A table hashes a vector with `width` functions floor((a.x + b) / w), a drawn from the normal distribution, which is
2-stable (and made orthogonal within a table); equal codes are a bucket. A query visits buckets in the order of their estimated success, its own and
those that are up to two steps away in each function. The estimate is the chance that a neighbour at a cosine rho falls into the
bucket: its projection is normal with mean rho * p and variance 1 - rho ** 2, p being the query's. Buckets are visited until their
chances, over all tables, sum up to `target`. The candidates of all tables are merged, and ranked by the inner product on the original vectors, in double
precision.

Largest inner products are smallest distances after one more component: rows become (v, sqrt(M ** 2 - |v| ** 2)) / M, M being the
largest length, and queries (q, 0) / |q|. Both have length one, so rows of any lengths are hashed by what decides their rank.

Two rounds: the first takes rho as FIRST, which near neighbours in clusters reach. What it finds bounds the k-th neighbour's rho from
below; a query whose visits don't reach the target at that rho visits more of them. One that found fewer than k, or that would need
more than `most` buckets of a table, visits all rows: the exact way for the rest. On vectors without clusters (neighbours at a
cosine of 0.4 in 64 dimensions) the visits hold most rows, as no few hash functions tell those neighbours from others; in clusters they hold few.

Layout: rows are dealt by (table, block), a block being the buckets of one value of a hash of their codes; a query goes, once, to each block
that holds a bucket it visits, with the list of these. So buckets are what is exchanged, and a query only reaches blocks that it has business in.
A block of more than BLOCK_ROWS rows, as a hot bucket or very many copies of a vector make it, is cut by a hash of the id, and its queries go to each part.
A part returns its own best `k` for a query, and these are ranked again. Width and the number of blocks grow with the rows.

Defined cases: vectors that are null, zero, of another size than most or hold null or non-finite components take no part, nor do
rows without an id; of rows that repeat an id the smallest vector counts; ties go to the smaller id; fewer than k candidates
give fewer rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm import common
from leafmark.llm.words import mix

TABLES, STEP_W, TARGET, FIRST, MOST = 2, 2.0, 0.95, 0.8, 2048
BLOCK_ROWS = 8192
MOVES = np.arange(-2, 3)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """By Abramowitz and Stegun 7.1.26; off by 1.5e-7 at most."""
    t = 1 / (1 + 0.3275911 * np.abs(x) / math.sqrt(2))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x / 2)
    return np.where(x < 0, tail / 2, 1 - tail / 2)


class Hashes:
    def __init__(self, dim: int, tables: int, width: int, w: float = STEP_W, seed: int = 20070923) -> None:
        rng = np.random.default_rng(seed)
        draws = [np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-width // dim))], 1)[:, :width] for _ in range(tables)]
        self.a, self.b, self.w = np.stack(draws) * math.sqrt(dim), rng.random((tables, width)) * w, w
        self.odd = rng.integers(0, 2**62, (tables, width)) * 2 + 1

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        return (np.floor((x @ self.a[table] + self.b[table]) / self.w).astype(np.int64) * self.odd[table]).sum(axis=1)

    def visits(self, x: np.ndarray, rho: np.ndarray, table: int, target: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of `most` buckets in order of their chances, and how many of them reach the target (0: not all of them do)."""
        p = x @ self.a[table]
        place = np.floor((p + self.b[table]) / self.w)
        left = (place[:, :, None] + MOVES) * self.w - self.b[table][:, None]
        mean, sd = (rho[:, None] * p)[:, :, None], np.sqrt(1 - np.clip(rho, -0.999, 0.999) ** 2)[:, None, None]
        cost = -np.log(np.clip(_normal_cdf((left + self.w - mean) / sd) - _normal_cdf((left - mean) / sd), 1e-12, None))
        total, code = np.zeros((len(x), 1)), (place.astype(np.int64) * self.odd[table]).sum(axis=1)[:, None]
        for j in range(cost.shape[1]):  # the best of all functions are among those that begin with the best of the first
            total = (total[:, :, None] + cost[:, j, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] + (MOVES * self.odd[table, j])[None, None, :]).reshape(len(x), -1)
            if total.shape[1] > most:
                best = np.argpartition(total, most - 1, axis=1)[:, :most]
                total, code = np.take_along_axis(total, best, 1), np.take_along_axis(code, best, 1)
        order = np.argsort(total, axis=1, kind="stable")
        total, code = np.take_along_axis(total, order, 1), np.take_along_axis(code, order, 1)
        chance = np.cumsum(np.exp(-total), axis=1)
        n = (chance < target).sum(axis=1) + 1
        return code, np.where(chance[:, -1] >= target, n, 0)


def _block(codes: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(codes.view(np.uint64)) % np.uint64(blocks)).astype(np.int32)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _indexed(hashes: Hashes, longest: float, blocks: int):
    """Rows of all tables: (t, block, code, vec_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column(1)) / longest
            x = np.column_stack([x, np.sqrt(np.maximum(1 - (x**2).sum(axis=1), 0))])
            for t in range(len(hashes.a)):
                codes = hashes.codes(x, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(_block(codes, blocks)), pa.array(codes), *b.columns], ["t", "block", "code", "vec_id", "v"])

    return run


_ASK = pa.schema([("t", pa.int32()), ("block", pa.int32()), ("query_id", pa.int64()), ("q", pa.list_(pa.float64())), ("codes", pa.binary())])
ASK = "t int, block int, query_id long, q array<double>, codes binary"


def _asked(hashes: Hashes, longest: float, blocks: int, target: float, most: int, first: float, again: bool):
    """(t, block, query_id, q, codes): of each query, the blocks it goes to, with the buckets it visits there (null: all)."""
    each = 1 - (1 - target) ** (1 / len(hashes.a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                q, ids = _vectors(b.column(1)), b.column(0).to_numpy()
                norm = np.linalg.norm(q, axis=1)
                x = np.column_stack([q / norm[:, None], np.zeros(len(q))])
                rho = np.full(len(q), first)
                few = np.zeros(len(q), bool)
                if again:
                    worst = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)  # of the k-th, null if there are fewer
                    few = np.isnan(worst)
                    rho = np.where(few, 0.0, worst / (longest * norm))
                visits = [hashes.visits(x, rho, t, each, most) for t in range(len(hashes.a))]
                enough, before = np.zeros(len(q), bool), None
                if again:
                    enough = ~few & (rho >= first)
                    before = [hashes.visits(x, np.full(len(q), first), t, each, most) for t in range(len(hashes.a))]
                    few |= np.any([n == 0 for _, n in visits], axis=0)
                out = []
                for i in np.flatnonzero(~enough):
                    if few[i]:
                        out += [(0, k, i, None) for k in range(blocks)]
                        continue
                    for t, (codes, n) in enumerate(visits):
                        own = codes[i, : n[i] or most]
                        if before:
                            own = np.setdiff1d(own, before[t][0][i, : before[t][1][i] or most])
                        block = _block(own, blocks)
                        order = np.argsort(block, kind="stable")
                        cuts = np.flatnonzero(np.append(True, block[order][1:] != block[order][:-1]))
                        out += [(t, int(block[order[a]]), i, np.sort(own[order[a:z]]).tobytes()) for a, z in zip(cuts, [*cuts[1:], len(own)], strict=True)]
                if out:
                    who = [r[2] for r in out]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array(ids[who]), pa.array(list(q[who]), pa.list_(pa.float64())), pa.array([r[3] for r in out], pa.binary())], schema=_ASK)

    return run


_FOUND = "query_id long, vec_id long, score double, seen long"


def _searched(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s, seen = [], [], [], []
        if rows.num_rows and queries.num_rows:
            rows, queries = rows.combine_chunks(), queries.combine_chunks()
            ids, v = rows.column("vec_id").to_numpy(), _vectors(rows.column("v").chunk(0))
            codes, of = np.unique(rows.column("code").to_numpy(), return_inverse=True)
            q_ids, q, wanted = queries.column("query_id").to_numpy(), _vectors(queries.column("q").chunk(0)), queries.column("codes").to_pylist()
            for at in range(0, len(q_ids), 128):
                part = q[at : at + 128]
                near = v @ part.T
                for i in range(len(part)):
                    ok = ids != q_ids[at + i]
                    if (want := wanted[at + i]) is not None:
                        want = np.frombuffer(want, np.int64)
                        place = np.minimum(np.searchsorted(want, codes), len(want) - 1)
                        ok &= (want[place] == codes)[of]
                    cand = np.flatnonzero(ok)
                    seen.append(len(cand))
                    s = near[cand, i]
                    if len(cand) > k:  # ties of the last place included; then the score that does not depend on the block
                        cand = cand[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9]
                    s = (v[cand] * part[i]).sum(axis=1)
                    order = np.lexsort((ids[cand], -s))[:k]
                    out_q.append(np.full(len(order), q_ids[at + i])), out_v.append(ids[cand][order]), out_s.append(s[order])
        none = [np.zeros(0)]
        found = [np.concatenate(x or none) for x in (out_q, out_v, out_s)]
        count = np.zeros(len(found[0]), np.int64)
        if len(count):
            count[0] = sum(seen)
        return pa.table([pa.array(x, t) for x, t in zip([*found, count], (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "vec_id", "score", "seen"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): what several tables, blocks or rounds found counts once."""
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")


def candidates(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, w: float = STEP_W, target: float = TARGET, first: float = FIRST, most: int = MOST) -> tuple[DataFrame, int]:
    """(query_id, vec_id, score, seen): the best k of each query in each part that it visits, and, summed over rows, how many rows it was held against; the number of rows that take part."""
    size_of = F.size(vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), size_of.alias("dim"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    size = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(length).alias("longest")).orderBy(F.desc("n"), "dim").first()
    dim, n, longest = (size["dim"], size["n"], size["longest"]) if size else (1, 0, 1.0)
    rows = rows.filter(F.col("dim") == dim)
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    blocks = max(-(-n // BLOCK_ROWS), 4)
    hashes = Hashes(dim + 1, tables, max(4, math.ceil(math.log(max(n, 2), 4))), w)
    kind = rows.schema["v"].dataType.simpleString()
    index = common.written(rows.select("vec_id", "v").mapInArrow(_indexed(hashes, longest, blocks), f"t int, block int, code long, vec_id long, v {kind}"), "vectors")
    asks = common.written(rows.filter("asks").select("vec_id", F.transform("v", lambda x: x.cast("double")).alias("v")), "queries")
    hot = common.cut(index.groupBy("t", "block").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("cuts")).filter("cuts > 1"))
    part = F.coalesce("cuts", F.lit(1))
    indexed = index.join(hot, ["t", "block"], "left").select("t", "block", F.pmod(F.xxhash64("vec_id"), part).cast("int").alias("part"), "code", "vec_id", "v")

    def search(queries: DataFrame, again: bool) -> DataFrame:
        asking = queries.mapInArrow(_asked(hashes, longest, blocks, target, most, first, again), ASK).join(hot, ["t", "block"], "left")
        asking = asking.select("t", "block", F.explode(F.sequence(F.lit(0), part - 1)).alias("part"), "query_id", "q", "codes")
        key = ("t", "block", "part")
        return common.written(indexed.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(_searched(k), _FOUND), "neighbours")

    one = search(asks, False)
    worst = _best(one, k).groupBy("query_id").agg(F.when(F.count("*") >= min(k, n - 1), F.min("score")).alias("worst"))
    two = search(asks.join(worst, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "worst"), True)
    return one.unionByName(two), n


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which is_query holds, among all other rows. options: of `candidates`."""
    return _best(candidates(vectors, is_query, k, **options)[0], k)


def op6_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
