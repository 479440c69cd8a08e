"""Byte-level BPE, encoding and decoding, with the ranks of a public vocabulary.

The pattern cuts a text into matches, each of which is merged on its own: pairs of neighbouring symbols
with the lowest rank first, of equal ranks the leftmost. A segment tree over the byte positions of a
match holds the pair that starts at each live position as rank and position in one number, so its root
is the leftmost minimum. A merge takes one position out and changes the pairs of two neighbours: three
point updates of logarithmic cost, however long the match.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import release, slices

#: Matches whose ids a Python worker remembers, in about 200 bytes each. It only saves time.
REMEMBERED = 400_000
#: A rank file larger than this is refused, as it is broadcast.
MOST_BYTES = 16 << 20


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match."""
    n = len(piece)
    if n == 0:
        return []
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    size = 1 << (n - 1).bit_length()
    none = len(ranks) * size + size
    tree = [none] * (2 * size)
    end = list(range(1, n + 1))  # where the symbol that starts at i ends
    before = list(range(-1, n))  # where the symbol before the one at i starts
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y

    while (least := tree[1]) != none:
        i = least & (size - 1)
        gone = end[i]
        stop = end[i] = end[gone]
        points = [(gone, None)]
        if stop < n:
            before[stop] = i
            points.append((i, rank(piece[i : end[stop]])))
        else:
            points.append((i, None))
        if i:
            p = before[i]
            points.append((p, rank(piece[p:stop])))
        for j, r in points:
            k = size + j
            tree[k] = none if r is None else r * size + j
            k >>= 1
            while k:
                x, y = tree[2 * k], tree[2 * k + 1]
                if y < x:
                    x = y
                if tree[k] == x:
                    break
                tree[k] = x
                k >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Remembered(dict):
    """The ids of matches, as bytes of int32, found or merged. Half of them at least stay: those in use go from the
    old half to the new one when they are met."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, match: str) -> bytes:
        if len(self) >= REMEMBERED // 2:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(match)
        if ids is None:
            ids = array("i", merge(match.encode(), self.ranks)).tobytes()
        self[match] = ids
        return ids


class ByteBPE:
    """Encoder and decoder for one rank file; remembers the matches it has merged."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        rows = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.pieces = {b: a for a, b in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.known = Remembered(self.ranks)

    def packed(self, text: str) -> bytes:
        """The ids of a text, as bytes of int32."""
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_coders: dict[tuple[int, str], ByteBPE] = {}


def _coder(rank_file: bytes, pattern: str) -> ByteBPE:
    key = (hash(rank_file), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBPE(rank_file, pattern)
    return _coders[key]


def _ranks(df: DataFrame, path: str):
    with open(path, "rb") as f:  # on the driver; executors get the bytes
        rank_file = f.read(MOST_BYTES + 1)
    if len(rank_file) > MOST_BYTES:
        raise ValueError(f"{path} exceeds {MOST_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(rank_file)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: id_col, ids (array of int), and with ``decoded`` the bytes that the ids give.

    Null and empty texts have no ids. Texts of any length are encoded whole. Rows with equal or null ids
    stay apart; other columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    shared = _ranks(docs, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [array("i", coder.packed(t.as_py() or "")) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.concatenate([np.frombuffer(x, np.int32) for x in ids]))
                out = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)]
                if decoded:
                    out.append(pa.array(map(coder.decode, ids), pa.binary(), size=len(ids)))
                yield pa.RecordBatch.from_arrays(out, ["id", "ids", "decoded"][: len(out)])
        release()

    schema = f"id {kind}, ids array<int>" + ", decoded binary" * decoded
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``tokens``: id_col and text, binary: what the ids stand for. Null ids: no bytes.

    An id outside the vocabulary raises ``KeyError``.
    """
    shared = _ranks(tokens, path)
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                out = [coder.decode(x) if x else b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["id", "text"])
        release()

    return tokens.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids").mapInArrow(run, f"id {kind}, text binary").withColumnRenamed("id", id_col)
