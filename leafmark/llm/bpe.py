"""Byte-level BPE encoding and decoding (7): a lazily determinised finite-state transducer.

Encoding reads a pretoken's bytes once, from left to right. The encoding of a prefix always ends in one
token that is compatible with the encoding of the rest, so it is enough to know, for each place at which a
token may still be open, the tokens up to there. A state is the set of those places, each as (trie node of
the open bytes, tokens not yet emitted). Tokens that all places share are emitted; what is open is at most
one token long, so the lookahead is bounded by the longest token. States and transitions are made when a
byte first asks for them, and kept: from then on the transducer is deterministic and a byte costs one lookup.

Decoding joins the tokens' bytes; `Utf8Stream` is the incremental UTF-8 state machine that turns a stream of
chunks into whole characters.

Defined cases: null or empty text has no tokens; every row gives a row, whatever its id.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import common

#: Unicode White_Space, which is what \s means to the libraries that the ids must agree with.
SPACE = r"\x09-\x0d\x20\x85\xa0  -     　"
ROOT, START, ANY = 0, -1, -2


class State(dict):
    """Arcs {byte: (state, emitted tokens)}, made when first asked for."""

    __slots__ = ("end", "kept", "last", "of", "places")

    def __missing__(self, byte: int) -> tuple[State, tuple[int, ...]]:
        arc = self.of.arc(self.last, self.places, byte)
        if len(self.of.states) < self.of.most_states or arc[0].kept:
            self[byte] = arc
        return arc


class Transducer:
    """Tokens of byte strings under ranks {token bytes: id}; the ids are also the order of merges."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 160_000) -> None:
        self.ranks, self.most_states = ranks, most_states
        self.children: dict[int, int] = {}
        self.token_at, self.inner = [-1], [False]
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for word, rank in ranks.items():
            self._add(word, rank)
            if len(word) > 1:
                a, b = self._last_merge(word, rank)
                self.halves[rank] = (a, b)
                self.joined[a, b] = rank
        self.fits: dict[int, bool] = {}
        self.states: dict[tuple, State] = {}
        self.start = self._state(START, ((ROOT, ()),))

    def _add(self, word: bytes, rank: int) -> None:
        node = ROOT
        for byte in word:
            self.inner[node] = True
            key = node << 8 | byte
            if (after := self.children.get(key)) is None:
                after = self.children[key] = len(self.token_at)
                self.token_at.append(-1)
                self.inner.append(False)
            node = after
        self.token_at[node] = rank

    def _last_merge(self, word: bytes, rank: int) -> tuple[int, int]:
        """The two tokens that the word is of before the merge that makes it."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                raise ValueError(f"token {rank} is not made by merges of lower rank")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _fit(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, together, are encoded as these two tokens. Merges are undone from
        the last to the first; at each time the two tokens that meet must not have been merged by then."""
        key = left << 20 | right
        if (known := self.fits.get(key)) is not None:
            return known
        if len(self.fits) > 300_000:
            self.fits.clear()
        before, ok = 1 << 40, True  # merges of a rank below this are still open across the border
        while True:
            if self.joined.get((left, right), before) < before:
                ok = False
                break
            a, b = self.halves.get(left), self.halves.get(right)
            if not a and not b:
                break
            # the later of the two merges is undone; of equal ranks the left one came first
            if b is None or (a and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]
        self.fits[key] = ok
        return ok

    def _state(self, last: int, places: tuple) -> State:
        """The states met first, which are the common ones, are kept; others are made again when needed."""
        key = (last, places)
        if (state := self.states.get(key)) is None:
            state = State()
            state.of, state.last, state.places, state.end = self, last, places, places[-1][1]
            state.kept = len(self.states) < self.most_states
            if state.kept:
                self.states[key] = state
        return state

    def arc(self, last: int, places: tuple, byte: int) -> tuple[State, tuple[int, ...]]:
        after, whole = [], None
        for node, tokens in places:
            if (child := self.children.get(node << 8 | byte)) is None:
                continue
            if whole is None and (t := self.token_at[child]) >= 0:
                before = tokens[-1] if tokens else last
                if before == START or self._fit(before, t):
                    whole = (*tokens, t)
            if self.inner[child]:
                after.append((child, tokens))
        after.append((ROOT, whole))
        shared = 0
        while after[0][1] and all(len(t) > shared for _, t in after) and len({t[shared] for _, t in after}) == 1:
            shared += 1
        emitted = whole[:shared]
        after = tuple((node, tokens[shared:]) for node, tokens in after)
        last = ANY if all(tokens for _, tokens in after) else emitted[-1] if emitted else last
        return self._state(last, after), emitted

    def __call__(self, word: bytes) -> list[int]:
        out: list[int] = []
        state = self.start
        for byte in word:
            state, emitted = state[byte]
            if emitted:
                out += emitted
        out += state.end
        return out


class Encoder:
    """Ids of texts as packed little-endian unsigned 32-bit integers. Text between spaces is encoded on its
    own (no pretoken crosses it) and remembered: the last `most` to 2 * `most` pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None, most: int = 200_000) -> None:
        self.transducer, self.most = Transducer(ranks), most
        self.fine = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.coarse = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.quick = re.compile(r" ?\S+|\s+(?!\S)|\s+")  # the same, but for U+001C to U+001F
        self.special = special or {}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = dict.fromkeys(range(max(ranks.values()) + 1), b"") | {v: k for k, v in ranks.items()} | {v: k.encode() for k, v in self.special.items()}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if (packed := self.older.get(piece)) is None:
            ids: list[int] = []
            if piece.isalpha() or (piece[0] == " " and piece[1:].isalpha()):  # the pattern takes it whole
                ids = self.transducer(piece.encode())
            else:
                for word in self.fine.findall(piece):
                    ids += self.transducer(word.encode())
            packed = array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.memo) >= self.most:
                self.older, self.memo = self.memo, {}
            self.memo[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut and any(s in text for s in self.special):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self.cut.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        pieces = (self.coarse if odd else self.quick).findall(text)
        known = list(map(self.memo.get, pieces))
        if None in known:
            known = [k or self._piece(x) for k, x in zip(known, pieces, strict=True)]
        return b"".join(known)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def text(self, ids: bytes, chunk: int = 4096) -> str:
        """Decoded as a stream of `chunk` ids at a time."""
        stream = Utf8Stream()
        return "".join([stream.feed(self.decode(ids[i : i + 4 * chunk])) for i in range(0, len(ids), 4 * chunk)]) + stream.feed(b"", True)


class Utf8Stream:
    """Characters of a stream of bytes, by a state machine. Its state are the bytes that the open character still needs, the
    bounds of the next one, and the bits read so far; a byte out of bounds ends the open character as U+FFFD and begins anew.
    Bytes between the first and the last character border of a chunk leave the state as it is and are decoded at once."""

    def __init__(self) -> None:
        self.need, self.low, self.high, self.bits = 0, 0x80, 0xBF, 0

    def step(self, byte: int) -> str:
        if self.need:
            if self.low <= byte <= self.high:
                self.need, self.low, self.high, self.bits = self.need - 1, 0x80, 0xBF, self.bits << 6 | byte & 0x3F
                return "" if self.need else chr(self.bits)
            self.need = 0
            return "\ufffd" + self.step(byte)
        self.low, self.high = 0x80, 0xBF
        if byte < 0x80:
            return chr(byte)
        if 0xC2 <= byte <= 0xDF:
            self.need, self.bits = 1, byte & 0x1F
        elif 0xE0 <= byte <= 0xEF:
            self.need, self.bits = 2, byte & 0x0F
            self.low, self.high = 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        elif 0xF0 <= byte <= 0xF4:
            self.need, self.bits = 3, byte & 0x07
            self.low, self.high = 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        else:
            return "\ufffd"
        return ""

    def feed(self, chunk: bytes, final: bool = False) -> str:
        out, at, end = [], 0, len(chunk)
        while at < end and self.need:
            out.append(self.step(chunk[at]))
            at += 1
        for back in range(1, min(3, end - at) + 1):  # a first byte among the last three may begin an open character
            if chunk[end - back] >= 0xC2:
                end -= back
                break
        out.append(chunk[at:end].decode("utf-8", "replace"))
        out += map(self.step, chunk[end:])
        if final and self.need:
            self.need = 0
            out.append("\ufffd")
        return "".join(out)


def ranks_of(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a .tiktoken file or of a byte-level .json vocabulary."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f))}, {}
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from U+0100
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in j["added_tokens"] if t.get("special")}
    return {bytes(byte_of[c] for c in word): i for word, i in j["model"]["vocab"].items() if word not in special}, special


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """One for each Python process."""
    if (path, pattern) not in _LOADED:
        ranks, special = ranks_of(path)
        _LOADED[path, pattern] = Encoder(ranks, pattern, special)
    return _LOADED[path, pattern]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, ids binary, n_tokens)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in common.steps(batches):
            ids = [e.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["id", "ids", "n_tokens"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary, n_tokens long").withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", chunk: int = 4096) -> DataFrame:
    """(id column, ids, text): ids decoded as a stream of `chunk` ids at a time."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in common.steps(batches, column="ids"):
            texts = [e.text(ids or b"", chunk) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ids"), pa.array(texts, pa.string())], ["id", "ids", "text"])

    common.small_batches(rows.sparkSession)
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, ids binary, text string").withColumnsRenamed({"id": id_col, "ids": ids_col})


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 4096) -> DataFrame:
    """(id column, ids, n_tokens, text): encoded and decoded again in one Python worker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in common.steps(batches):
            ids = [e.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([e.text(x, chunk) for x in ids], pa.string())], ["id", "ids", "n_tokens", "text"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary, n_tokens long, text string").withColumnRenamed("id", id_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
