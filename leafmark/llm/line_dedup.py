"""Line dedup (1): range-partitioned line hashes, secondary sort by document, keep bitmaps.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z in lower case. A key of `min_chars`
code points or more that two documents hold stays only in the document with the smallest id; other
documents lose every line with it. The rows that travel carry a 128-bit hash, an id and a position, never
text; what comes back is one compressed keep bitmap for each document that loses a line.

Skew: each step of a map task first settles its own repeats (a document that is not the smallest of the
step loses the line there and then), so a hot line sends one document's rows for each step. Marks are written once, so that
texts are hashed once (range cuts are sampled from the marks) and settled ones don't travel. The others are
range-partitioned by (hash, id) and sorted by hash, document and position, which also splits what is left of a hot line. Where a run of equal
hashes crosses a partition border, only the first document of the run is undecided; it is settled by a
join with one row for each partition.

Defined cases: null or empty text is one empty line; null ids are one document, smaller than all others;
rows that repeat an id count as one document, each row keeping its own bitmap (told apart by 128 bits of
the text's hash); an empty table gives an empty result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import common

WHITE = " \t\n\x0b\x0c\r"
MARK = "kind tinyint, h1 long, h2 long, id long, t1 long, t2 long, pos int"
FIRST, DROP, PENDING, LAST = 0, 1, 2, 3
_MARKS = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("pos", pa.int32())])


def _marks(kind, *columns) -> pa.RecordBatch:
    """columns: h1 to pos; those that are None are null."""
    n = len(columns[2])
    kind = np.full(n, kind, np.int8) if np.isscalar(kind) else kind
    return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.nulls(n, f.type) if x is None else pa.array(x) for x, f in zip(columns, list(_MARKS)[1:], strict=True))], schema=_MARKS)


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of the texts, and the number of lines of each."""
    lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


def _hashed(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.gathered(batches):
            lines, counts = _lines(b.column("text"))
            keys = pc.ascii_lower(pc.ascii_trim(lines, characters=WHITE))
            keep = pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)
            if not keep.any():
                continue
            row = np.repeat(np.arange(len(counts)), counts)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            row, pos, digest = row[keep], pos[keep].astype(np.int32), xxhash.xxh3_128_digest
            h = np.frombuffer(b"".join([digest(k) for k in keys.filter(pa.array(keep)).to_pylist()]), dtype=np.int64).reshape(-1, 2)
            ids, t1, t2 = (b.column(b.schema.get_field_index(c)).to_numpy()[row] for c in ("id", "t1", "t2"))
            order = np.lexsort((pos, ids, h[:, 1], h[:, 0]))
            h, ids, t1, t2, pos = h[order], ids[order], t1[order], t2[order], pos[order]
            new = np.append(True, (h[1:] != h[:-1]).any(axis=1))
            owner = ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
            yield _marks(np.where(ids == owner, FIRST, DROP).astype(np.int8), h[:, 0], h[:, 1], ids, t1, t2, pos)

    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams one partition, sorted by hash, document and position; holds one batch, the last key and its first document."""
    last, owner, runs = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        _, h1, h2, ids, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        new = np.append(last != (h1[0], h2[0]), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
        first = np.where(at >= 0, ids[at], owner)
        run = runs + np.cumsum(new)
        gone, open_ = ids != first, (run == 1) & (ids == first)
        if gone.any():
            yield _marks(DROP, None, None, ids[gone], *(x[gone] for x in rest))
        if open_.any():
            yield _marks(PENDING, h1[open_], h2[open_], ids[open_], *(x[open_] for x in rest))
        last, owner, runs = (h1[-1], h2[-1]), first[-1], run[-1]
    if last:
        none = np.zeros(1, np.int64)
        yield _marks(LAST, np.array([last[0]]), np.array([last[1]]), np.array([owner], np.int64), none, none, none.astype(np.int32))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = []
        for gone in b.column("gone").to_pylist():
            keep = np.ones((max(gone) // 8 + 1) * 8, np.uint8)  # whole bytes: padding must not drop lines
            keep[gone] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(maps, pa.binary())], ["id", "t1", "t2", "keep"])


def kept_lines(bitmap: bytes | None, n: int) -> np.ndarray:
    """Booleans for the n lines of a text; lines beyond the bitmap are kept."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
        keep[: len(bits)] = bits
    return keep


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, t1, t2, keep): for each document that loses a line, the compressed bitmap of the lines it keeps."""
    common.small_batches(docs.sparkSession)
    t1, t2 = common.tags(text_col)
    rows = docs.select(common.ident(id_col).alias("id"), t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text"))
    hashed = common.written(rows.mapInArrow(_hashed(min_chars), MARK), "line-hashes")
    ranges = hashed.filter(F.col("kind") == FIRST).repartitionByRange("h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "pos")
    marks = common.written(ranges.mapInArrow(_first_occurrences, MARK), "line-marks")
    before = marks.filter(F.col("kind") == LAST).groupBy("h1", "h2").agg(F.min("id").alias("first"))
    late = marks.filter(F.col("kind") == PENDING).join(before, ["h1", "h2"]).filter("first < id")
    key = ("id", "t1", "t2")
    gone = lambda df: df.filter(F.col("kind") == DROP).select(*key, "pos")
    drops = gone(hashed).unionByName(gone(marks)).unionByName(late.select(*key, "pos"))
    return drops.groupBy(*key).agg(F.collect_set("pos").alias("gone")).mapInArrow(_packed, "id long, t1 long, t2 long, keep binary")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.steps(batches, column="__text"):
        texts, n_lines, n_dropped = [], [], []
        for text, bitmap in zip(b.column("__text").to_pylist(), b.column("__keep").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            if bitmap is not None:
                keep = kept_lines(bitmap, len(lines))
                text = "\n".join([x for x, k in zip(lines, keep, strict=True) if k])
                n_dropped.append(len(lines) - int(keep.sum()))
            else:
                n_dropped.append(0)
            texts.append(text)
        new = [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        rest = [i for i, name in enumerate(b.schema.names) if name not in ("__text", "__keep")]
        yield pa.RecordBatch.from_arrays([b.column(i) for i in rest] + new, [b.schema.names[i] for i in rest] + ["__new_text", "__n_lines", "__n_dropped"])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, counts: bool = False) -> DataFrame:
    """docs with repeated lines gone from the text; with `counts`, also n_lines and n_dropped (which replace
    columns of these names). A null text stays null."""
    key = ("__id", "__t1", "__t2")
    keep = line_keep_bitmaps(docs, id_col, text_col, min_chars).toDF(*key, "__keep")
    named, names, types = common.inner(docs)
    text = names[docs.columns.index(text_col)]
    rest = [c for c in names if c != text]
    t1, t2 = common.tags(text)
    rows = named.select(*rest, F.col(text).alias("__text"), common.ident(names[docs.columns.index(id_col)]).alias("__id"), t1.alias("__t1"), t2.alias("__t2"))
    schema = "".join(f"{c} {t}, " for c, t in zip(names, types, strict=True) if c != text)
    out = rows.join(keep, list(key), "left").drop(*key).mapInArrow(_applied, schema + "__new_text string, __n_lines long, __n_dropped long")
    columns = [F.col("__new_text" if c == text else c).alias(name) for c, name in zip(names, docs.columns, strict=True) if not (counts and name in ("n_lines", "n_dropped"))]
    return out.select(*columns, *([F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped")] if counts else []))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs, counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Over duckdb's views of the same tables.
SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), owner AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k
), judged AS (
  SELECT keyed.*, coalesce(keyed.doc_id > owner.first, false) AS gone FROM keyed LEFT JOIN owner USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
