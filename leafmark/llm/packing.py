"""Best-fit packing (9): large-item matching, then best fit of the small into the gaps.

A document's tokens (its ids and one closing id) are cut to `capacity` where they are longer; the pieces are
packed into sequences of at most `capacity`. Pieces of one length are alike, so the plan is made on the
histogram of lengths (at most `capacity` numbers, however many documents there are): pieces above one third
of the capacity share a sequence with at most one other of these, the largest first with the largest partner
that fits; shorter ones, the largest first, go to the smallest gap that holds them, or to a new sequence.
The plan is a list of runs "pieces number a to b of length n are the k-th item of sequences s to t", of a
size that depends on the capacity alone. The pieces are then numbered within their length: each task numbers
its own, and a sum over tasks moves these numbers up. No task sees all pieces of a length.

Defined cases: null or empty text is the closing id alone; null ids and rows that repeat an id are packed as
rows of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm import bpe, common

_LOADED: dict[str, tiktoken.Encoding] = {}


def tokenizer(path: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level .json file in the fastest library at hand; tests hold its ids against
    those of `tokenizers`, special tokens in the text included."""
    if path not in _LOADED:
        ranks, special = bpe.ranks_of(path)
        _LOADED[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _LOADED[path]


def _pieces(path: str, capacity: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, task = tokenizer(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = np.array([closing], "<u4")
        for b in common.steps(batches):
            row, piece, start, length, crc, number = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.append(t.encode_to_numpy(text, allowed_special="all", disallowed_special=()), end) if text else end
                ids = ids.astype("<u4", copy=False)
                at, until, k = 0, (len(ids) - 1) % capacity + 1, 0
                while at < len(ids):
                    n = until - at
                    row.append(i), piece.append(k), start.append(at), length.append(n)
                    crc.append(zlib.crc32(ids[at:until].tobytes())), number.append(seen[n])
                    seen[n] += 1
                    at, until, k = until, until + capacity, k + 1
            columns = [b.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(number, pa.int64()), pa.array([task] * len(row), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "number", "task"])

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs (length, number of the first piece, first sequence, offset), each up to the next run of its length."""
    left = Counter({n: c for n, c in counts.items() if c > 0})
    classes: list[tuple[tuple[int, ...], int]] = []  # (lengths in a sequence, sequences like this)
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(items: tuple[int, ...], n: int) -> None:
        if n and (gap := capacity - sum(items)):
            gaps.setdefault(gap, []).append((items, n))
        elif n:
            classes.append((items, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in large:
            if b > a or a + b > capacity or not left[a] or not left[b]:
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            left[a] -= n
            left[b] -= n
            put((a, b), n)
        if left[a]:
            put((a,), left[a])
            left[a] = 0
    for s in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        while left[s]:
            gap = min((g for g in gaps if g >= s and gaps[g]), default=None)
            items, n = gaps[gap].pop() if gap is not None else ((), left[s])
            each = (gap if gap is not None else capacity) // s
            full = min(n, left[s] // each)
            left[s] -= full * each
            put(items + (s,) * each, full)
            if full < n and left[s]:  # the last sequence of this kind takes what is left
                put(items + (s,) * left[s], 1)
                left[s] = 0
                full += 1
            if items:
                put(items, n - full)
    classes += [c for same in gaps.values() for c in same]
    runs, number, sequence = [], Counter(), 0
    for items, n in classes:
        offset = 0
        for length in items:
            runs.append((length, number[length], sequence, offset))
            number[length] += n
            offset += length
        sequence += n
    return runs


def _placed(runs: list[tuple[int, int, int, int]]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 50 | table[:, 1]
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 50 | number, "right") - 1
            new = [pa.array(table[at, 2] + number - table[at, 1]), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays([b.column(x) for x in ("id", "piece", "start", "length", "ids_crc32")] + new, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = 1024, closing: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = common.written(rows.mapInArrow(_pieces(path, capacity, closing), f"{schema}, number long, task int"), "pieces")
    of_task = common.cut(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in of_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    moved = of_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(moved, ["length", "task"]).withColumn("rank", F.col("base") + F.col("number"))
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(plan(counts, capacity)), f"{schema}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
