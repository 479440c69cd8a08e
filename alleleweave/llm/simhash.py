"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints within the radius r are found with 2**(r+1) - 1 tables, one for each non-zero vector v of
r+1 bits. Each bit position i of a fingerprint carries a non-zero vector a(i); table v looks at the bits
with <a(i), v> odd. The vectors of r differing positions span at most r dimensions, so some v is
orthogonal to all of them, and in that table the two fingerprints agree on every bit looked at: every
pair within the radius collides in some table, with certainty.

Only distinct fingerprints are compared. A bucket that is still large is cut by a second covering over the
bits its table doesn't look at. After that 48 of 64 bits agree at least, so a bucket can't hold more than
2**16 fingerprints, whatever the data. A bucket gives a tree for each of its clusters, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release
from .components import components

RADIUS = 3
SHINGLE = 3
#: Buckets with more fingerprints are cut by the second covering.
LARGE = 2048
SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def covering(free: int = (1 << 64) - 1, radius: int = RADIUS) -> list[int]:
    """The masks of a covering of the bit positions in ``free``."""
    tables = (1 << (radius + 1)) - 1
    at = [i for i in range(64) if free >> i & 1]
    return [sum(1 << i for n, i in enumerate(at) if ((n % tables + 1) & v).bit_count() & 1) for v in range(1, tables + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles in their order; of a shorter text, of all its words."""
    words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(k))))
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(words) - k + 1)


def folded(hashes: np.ndarray) -> int:
    """The SimHash of shingles' hashes, 0 if there are none."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        h = hashes[start : start + CHUNK]
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, 0 if it has no words."""
    return folded(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): a row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])
        release()

    return docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS BINARY) AS text").mapInArrow(run, f"id {kind}, fp long")


def _tables(df: DataFrame, free: int, level: str, radius: int):
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(signed(m)).alias("mask")) for t, m in enumerate(covering(free, radius))])
    df = df.withColumn("m", F.explode(masks))
    return df.withColumn(f"t{level}", F.col("m.t")).withColumn(f"key{level}", F.col("fp").bitwiseAND(F.col("m.mask"))).drop("m")


def clusters(fp: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges that join those of ``fp`` (distinct) which links of up to ``radius`` bits connect."""
    rest = fp.copy()
    while len(rest):
        first, rest = rest[0], rest[1:]
        queue = [first]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                for x in found:
                    yield first, x


def _links(buckets: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Edges (a, b) from ``buckets`` (keys, fp), dealt out by key and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:-1]], axis=0)) + 1
            starts, ends = np.r_[0, new], np.r_[new, len(cols[0])]
            fp, size = cols[-1], ends - starts
            two = starts[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            more = [e for s, t in zip(starts[size > 2], ends[size > 2]) for e in clusters(fp[s:t], radius)]
            pairs = np.concatenate([np.stack([fp[two], fp[two + 1]], 1), np.array(more, np.uint64).reshape(-1, 2)])
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(batch.num_columns)]
            cols[-1] = cols[-1].view(np.uint64)
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:-1]], axis=0)) + 1
            if len(new):  # all but the last bucket are complete
                yield edges([c[: new[-1]] for c in held])
                held = [c[new[-1] :] for c in held]
        if held is not None:
            yield edges(held)

    dealt = buckets.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of ``distinct`` (fp) as links of up to ``radius`` bits do."""
    keyed = _tables(distinct.select("fp"), (1 << 64) - 1, "", radius)
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = checkpointed(keyed.join(sizes, ["t", "key"]))
    out = _links(keyed.where(F.col("n") <= large), ["t", "key"], radius)
    masks = covering(radius=radius)
    for (t,) in keyed.where(F.col("n") > large).select("t").distinct().orderBy("t").collect():  # at most as many as tables
        hot = keyed.where((F.col("n") > large) & (F.col("t") == t))
        out = out.union(_links(_tables(hot, ~masks[t] & ((1 << 64) - 1), "2", radius), ["t", "key", "t2", "key2"], radius))
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """One row per row of ``docs``: id_col, fp (long), component_id.

    component_id is the least id reachable by links of up to ``radius`` differing bits. Null and empty texts,
    and texts of white space, have fingerprint 0 and are linked like any other. Rows with equal ids each
    get a row; a null id never is a component_id unless its component has no other. Other columns are
    ignored; an empty table gives an empty result.
    """
    each = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    distinct = each.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(distinct, radius, large))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = checkpointed(named)
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(best, "root").select("fp", "component_id")
    return each.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
