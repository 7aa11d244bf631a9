"""Substring dedup (5): level-wise doubling over word windows.

A window is `window` consecutive words of one document. A word goes if a window over it also starts in a
document with a smaller id. Levels are windows of 4, 8, ... words, twice as long each time, up to `window`. At each level
only windows that are still candidates are looked at; those whose words at this length occur in one document alone are out, the
others are extended to the next length. At the last length the whole window decides: it goes where a smaller id has it too.
It ends as soon as no candidate survives. (Repeats longer than the window are made of windows that are known by then.)

Representatives: below full length, a window stands for itself by the one of its shorter windows with the smallest
hash. That is the same one wherever the words are the same, and mostly the same one for its neighbours, so a level sends one
number of 32 bits for about five places at 4 words. Equal numbers by chance only let a candidate through to the next level; at full
length 96 bits decide.

Layout: texts are dealt once to buckets, written as a table bucketed by them, and read from there at each level without
a shuffle. What a level shuffles are each bucket's distinct numbers, cut to parts of the number space; what comes back is one bit
for each. No text, place or id goes with them before the last level, which sends (hash, smallest id) of each distinct window.

Skew: a bucket sends a number once, however often its texts hold it, so a passage in a third of all rows is one entry for each
bucket. A phrase that is followed by very many different words is one number at its own level, and its continuations
have hashes of their own, which go to different parts. Buckets are made by a hash of id and text (and, for null ids, of the scan's
partition), so one id can't fill a bucket; buckets and parts grow in number with the input, not in size. Only a single
text is held whole.

Defined cases: null text has no words; null ids are one document, smaller than all others; rows that repeat
an id are one document, each judged for its own words; an empty table gives an empty result; other columns,
whatever their names, pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import common
from leafmark.llm.words import Words, covered

SHORTEST = 4
#: Bytes of text in a bucket, in a part of the number space, and in a file of the dealt table.
BUCKET_BYTES, PART_BYTES, FILE_BYTES = 16 << 20, 1 << 29, 1 << 25
LEAST_BUCKETS = 256
SENT = "part int, bucket int, data binary"
REPLY = "bucket int, level int, part int, bits binary, live long"
_REPLY = pa.schema([("bucket", pa.int32()), ("level", pa.int32()), ("part", pa.int32()), ("bits", pa.binary()), ("live", pa.int64())])


def levels(window: int) -> list[int]:
    out, n = [], SHORTEST
    while n < window:
        out.append(n)
        n *= 2
    return [*out, window]


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs that begin where new is true."""
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else pa.array([], column.type) if isinstance(column, pa.ChunkedArray) else column


class Bucket:
    """The texts of a bucket and the starts of their windows that are still candidates."""

    def __init__(self, rows: pa.Table, window: int, parts: int) -> None:
        self.text = _whole(rows.column("__text"))
        self.words = Words(self.text)
        self.ids = rows.column("__id").to_numpy()
        self.window, self.parts = window, parts
        self.live = np.flatnonzero(self.words.windows(window)[1])

    def numbers(self, length: int) -> np.ndarray:
        """Of each candidate, part and number at this length: the smallest hash of the windows of this length in it."""
        h = self.words.windows(length)[0]
        least = h[: max(len(h) - (self.window - length), 0)].copy()
        for j in range(1, self.window - length + 1):
            np.minimum(least, h[j : j + len(least)], out=least)
        h = least[self.live]
        return (h >> np.uint64(32)) % np.uint64(self.parts) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)

    def distinct(self, length: int) -> tuple[np.ndarray, ...]:
        """Distinct numbers in order (at full length: parts, hashes, checks), place of each candidate among them, smallest and largest id of each."""
        d = self.ids[self.words.row[self.live]]
        if length < self.window:
            keys = (self.numbers(length),)
            order = np.argsort(keys[0], kind="stable")
        else:
            h, c = self.words.windows(length)[0][self.live], self.words.windows(length, other=True)[0][self.live]
            keys = ((h >> np.uint64(32)) % np.uint64(self.parts), h, c >> np.uint64(32))
            order = np.lexsort(keys[::-1])
        keys, d = tuple(k[order] for k in keys), d[order]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        first = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        low, high = (f.reduceat(d, first) if len(first) else d for f in (np.minimum, np.maximum))
        return (*(k[first] for k in keys), place, low, high)

    def survive(self, replies: pa.Table) -> None:
        """Keeps the candidates that the replies of the levels below full length let through."""
        for length in levels(self.window)[:-1]:
            if (bits := _bits(replies, length)) is None:
                return
            *_, place, _, _ = self.distinct(length)
            self.live = self.live[bits[place]] if len(place) else self.live


def _bits(replies: pa.Table, length: int) -> np.ndarray | None:
    """The answers to a bucket's distinct numbers, in their order."""
    some = replies.filter(pc.equal(replies.column("level"), length)).sort_by("part")
    if not some.num_rows:
        return None
    out = []
    for x in some.column("bits").to_pylist():
        n = int(np.frombuffer(x, "<u4", 1)[0])
        out.append(np.unpackbits(np.frombuffer(x, np.uint8, offset=4), count=n).astype(bool))
    return np.concatenate(out)


def _packed(bits: np.ndarray) -> bytes:
    return np.uint32(len(bits)).tobytes() + np.packbits(bits).tobytes()


def _sent(window: int, length: int, parts: int):
    def run(rows: pa.Table, replies: pa.Table | None = None) -> pa.Table:
        b = Bucket(rows, window, parts)
        if replies is not None:
            b.survive(replies)
        out = []
        if len(b.live):
            if length < window:
                keys, _, low, high = b.distinct(length)
                part, columns = keys >> np.uint64(32), (keys.astype("<u4"),)
                flags = low != high
            else:
                part, h, c, _, low, _ = b.distinct(length)
                columns, flags = (h, c.astype("<u4"), low), None
            for a, n in zip(*_runs(np.append(True, part[1:] != part[:-1])), strict=True):
                data = b"".join(x[a : a + n].tobytes() for x in columns)
                out.append((int(part[a]), np.uint32(n).tobytes() + data + (np.packbits(flags[a : a + n]).tobytes() if flags is not None else b"")))
        bucket = rows.column("__bucket")[0].as_py()
        return pa.table({"part": pa.array([x for x, _ in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "data": pa.array([x for _, x in out], pa.binary())})

    return (lambda rows: run(rows)) if length == levels(window)[0] else (lambda rows, replies: run(rows, replies) if rows.num_rows else _nothing())


def _nothing() -> pa.Table:
    return pa.table({"part": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})


def _answered(length: int, last: bool):
    """Of a part: for each bucket, which of its numbers other documents have too; at full length, smaller ones."""

    def run(sent: pa.Table) -> pa.Table:
        data = sent.column("data").to_pylist()
        sizes = np.array([int(np.frombuffer(x, "<u4", 1)[0]) for x in data])
        read = lambda kind, skip: np.concatenate([np.frombuffer(x, kind, n, 4 + skip * n) for x, n in zip(data, sizes.tolist(), strict=True)])
        if last:
            h, c, ids = read("<u8", 0), read("<u4", 8), read("<i8", 12)
            order = np.lexsort((ids, c, h))
            same = (h[order[1:]] == h[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
            new = np.append(True, ~same)
            least = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            yes = np.empty(len(order), bool)
            yes[order] = ids[order] > least
        else:
            number = read("<u4", 0)
            several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=4 + 4 * n), count=n) for x, n in zip(data, sizes.tolist(), strict=True)])
            order = np.argsort(number, kind="stable")
            first, n = _runs(np.append(True, number[order[1:]] != number[order[:-1]]))
            yes = np.empty(len(order), bool)
            yes[order] = np.repeat((n > 1) | (np.add.reduceat(several[order].astype(np.int64), first) > 0), n)
        cuts = np.split(yes, np.cumsum(sizes)[:-1])
        rows = sent.num_rows
        columns = [sent.column("bucket"), pa.array([length] * rows, pa.int32()), sent.column("part"), pa.array([_packed(x) for x in cuts], pa.binary()), pa.array([int(x.sum()) for x in cuts], pa.int64())]
        return pa.table(columns, schema=_REPLY)

    return run


def _cut_out(window: int, parts: int, joined: bool, rest: list[str]):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        b = Bucket(rows, window, parts)
        w, texts = b.words, b.text
        b.survive(replies)
        removed = np.zeros(len(w.starts), bool)
        if (bits := _bits(replies, window)) is not None:
            *_, place, low, _ = b.distinct(window)
            gone = b.live[bits[place] | (b.ids[w.row[b.live]] > low[place])]
            removed = covered(gone, window, len(w.starts))
        base, n = np.cumsum(w.counts) - w.counts, len(w.counts)
        n_removed = np.bincount(w.row[removed], minlength=n)
        raw, out, nulls = w.bytes.tobytes(), [], texts.is_null().to_pylist()
        for i in range(n):
            a, z = base[i], base[i] + w.counts[i]
            if joined:
                keep = np.flatnonzero(~removed[a:z]) + a
                out.append(b" ".join([raw[s:e] for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)]))
            elif not n_removed[i]:
                out.append(None if nulls[i] else raw[w.bounds[i] : w.bounds[i + 1]])
            else:  # what stands between kept neighbours stays; a gap becomes a break if it held one
                keep = ~removed[a:z]
                first = np.flatnonzero(keep & np.append(True, ~keep[:-1])) + a
                last = np.flatnonzero(keep & np.append(~keep[1:], True)) + a
                pieces, end = [], None
                for s, e in zip(w.starts[first].tolist(), w.ends[last].tolist(), strict=True):
                    pieces += [b"" if end is None else b"\n" if b"\n" in raw[end:s] else b" ", raw[s:e]]
                    end = e
                out.append(b"".join(pieces))
        new = [pa.array(out, pa.binary()).cast(pa.string()), pa.array(w.counts, pa.int64()), pa.array(n_removed, pa.int64())]
        return pa.table([rows.column(c) for c in rest] + new, names=[*rest, "__new", "__n_words", "__n_removed"])

    return run


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, joined: bool = False, counts: bool = False) -> DataFrame:
    """docs with repeated words gone from the text. joined: kept words are joined by one space; else texts
    without repeats stay as they are, and what stands between kept words stays. counts: also n_words and
    n_removed (which replace columns of these names)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets, parts = (max(LEAST_BUCKETS, -(-size // n)) for n in (BUCKET_BYTES, PART_BYTES))
    files = max(spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    named, names, types = common.inner(docs)
    text, key = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    rest = [c for c in names if c != text]
    salt = F.when(F.col(key).isNull(), F.spark_partition_id()).otherwise(0)
    bucket = F.pmod(F.xxhash64(common.ident(key), text, salt), F.lit(buckets)).cast("int")
    rows = common.dealt(named.select(*rest, F.col(text).alias("__text"), common.ident(key).alias("__id"), bucket.alias("__bucket")), "texts", "__bucket", files)
    slim, replies = rows.select("__bucket", "__id", "__text"), None
    for length in levels(window):
        make = _sent(window, length, parts)
        if replies is None:
            sent = slim.groupBy("__bucket").applyInArrow(make, SENT)
        else:
            sent = slim.groupBy("__bucket").cogroup(replies.groupBy("bucket")).applyInArrow(make, SENT)
        reply = common.written(sent.groupBy("part").applyInArrow(_answered(length, length == window), REPLY), f"windows-of-{length}")
        replies = reply if replies is None else replies.unionByName(reply)
        if not reply.agg(F.sum("live")).first()[0]:
            break
    schema = "".join(f"{c} {t}, " for c, t in zip(names, types, strict=True) if c != text) + "__new string, __n_words long, __n_removed long"
    out = rows.groupBy("__bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_cut_out(window, parts, joined, rest), schema)
    columns = [F.col("__new" if c == text else c).alias(name) for c, name in zip(names, docs.columns, strict=True) if not (counts and name in ("n_words", "n_removed"))]
    return out.select(*columns, *([F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed")] if counts else []))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_passages(docs, joined=True, counts=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Over duckdb's views of the same tables.
SQL = r"""
WITH w AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents)
), seq AS (
  SELECT doc_id, pos, word,
         CASE WHEN lead(pos, 12) OVER p IS NOT NULL
              THEN array_to_string(array_agg(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING), ' ') END AS win
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
), owner AS (
  SELECT win, min(doc_id) AS first FROM seq WHERE win IS NOT NULL GROUP BY win HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT seq.doc_id, seq.pos, seq.word, coalesce(seq.doc_id > owner.first, false) AS starts FROM seq LEFT JOIN owner USING (win)
), judged AS (
  SELECT doc_id, pos, word, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hit
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS t
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
