"""Approximate nearest neighbours: inverted lists scanned by adaptive dimensions.

Vectors are rotated at random, once, so that any leading coordinates are a fair sample of all. Each vector
belongs to the list of its nearest centroid. A list keeps its vectors in column blocks; for a query the
blocks are read one after another, and after each a hypothesis test compares the distance so far with that of
the current k-th best neighbour: d of D coordinates give an estimate sqrt(D/d) * partial that rarely
exceeds the true distance by more than a factor 1 + EPSILON / sqrt(d), so a candidate beyond that is
abandoned. The survivors' distances are computed in double precision on the original vectors, and the k-th best
is brought up to date before the next rows are read.

A query scans its nearest list first; its k-th best distance there goes with it to the other lists that it probes,
where most candidates are abandoned early.

Centroids are fitted on a bounded sample (``SAMPLE`` rows, in the order of their ids' hashes), and the number
of lists to probe is the smallest that finds ``RECALL`` of the true neighbours within that sample; every
vector is indexed and every list can be probed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SAMPLE = 16_384
CALIBRATION = 256
RECALL = 0.97
MOST_LISTS = 1024
LIST_ROWS = 256
#: Rows of a list, and queries, that are held by one task at a time.
CHUNK_ROWS = 16_384
CHUNK_QUERIES = 4_096
COLUMNS = 16
EPSILON = 2.1
#: Rows that are read before the k-th best is brought up to date; fewer at first, as there is none yet.
STEP, FIRST_STEP = 2_048, 128
#: Partial and whole distances are sums of rounded squares: so many times their rounding never decides.
ROUNDING = 64 * np.finfo(float).eps


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means; lists that become empty keep their centroid."""
    distinct = np.unique(sample, axis=0)
    c = distinct[np.random.default_rng(3).permutation(len(distinct))[:lists]].copy()
    for _ in range(rounds):
        near = _squared(sample, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def calibrated_probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The smallest number of lists that holds ``recall`` of the k nearest within the sample."""
    q = sample[:CALIBRATION]
    if len(sample) <= k + 1:
        return len(centroids)
    d = _squared(q, sample)
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argpartition(d, k, axis=1)[:, :k]
    of = _squared(sample, centroids).argmin(1)
    rank = _squared(q, centroids).argsort(1).argsort(1)  # of each list, for each query
    found = np.sort(np.take_along_axis(rank, of[near], 1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean, the squares added one after another, as a loop would."""
    return np.sqrt(np.cumsum((rows - q) ** 2, axis=1)[:, -1])


def scan(rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, turn: np.ndarray, k: int, limits: np.ndarray | None = None) -> Iterator[tuple[int, int, float]]:
    """(query id, id, distance): for each query its k nearest of ``rows``, ties to smaller ids, abandoning early.

    ``limits`` are distances beyond which a query has no use for a candidate.
    """
    turned, dims = rows @ turn, rows.shape[1]
    blocks = [np.ascontiguousarray(turned[:, s : s + COLUMNS]) for s in range(0, dims, COLUMNS)]
    largest = (rows * rows).sum(1).max(initial=0.0)
    for at, (q, qid) in enumerate(zip(queries, query_ids)):
        t, slack = q @ turn, ROUNDING * (q @ q + largest)
        limit = np.inf if limits is None else limits[at] ** 2
        best, best_ids, begin, step = np.zeros(0), np.zeros(0, ids.dtype), 0, FIRST_STEP
        while begin < len(rows):
            alive = np.arange(begin, min(begin + step, len(rows)))
            begin, step = begin + step, STEP
            alive = alive[ids[alive] != qid]
            part, d = np.zeros(len(alive)), 0
            for b in blocks:
                part = part + ((b[alive] - t[d : d + b.shape[1]]) ** 2).sum(1)
                d += b.shape[1]
                if limit < np.inf:
                    factor = (1 + EPSILON / np.sqrt(d)) ** 2 if d < dims else 1
                    keep = part * (dims / d) <= limit * factor + slack
                    alive, part = alive[keep], part[keep]
            if not len(alive):
                continue
            best = np.r_[best, distances(rows[alive], q)]
            best_ids = np.r_[best_ids, ids[alive]]
            first = np.lexsort((best_ids, best))[:k]
            best, best_ids = best[first], best_ids[first]
            if len(best) == k:
                limit = min(limit, best[-1] ** 2)
        for i, x in zip(best_ids, best):
            yield int(qid), int(i), float(x)


def clean_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def nearest(table: DataFrame, is_query: Callable[[Column], Column], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found of each query, by Euclidean distance, rank from 1, ties
    to the smaller id.

    Queries are the rows for whose id ``is_query`` holds, candidates all rows with another id. Vectors that are
    null, zero, or hold a null or a number that isn't finite, rows with a null id, and vectors of another
    length than most take no part. Of queries that share an id one is used, the least vector; rows that
    share an id are candidates each. With fewer than k candidates all are returned. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = table.sparkSession
    v = clean_vectors(table.select(id_col, vector_col), id_col, vector_col)
    sizes = v.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    if not sizes:
        return empty
    dims, n = sizes[0]["dims"], sizes[0]["n"]
    v = v.where(F.size("v") == dims)
    sample = np.array([r["v"] for r in v.orderBy(F.xxhash64("id"), "v").limit(SAMPLE).collect()], float)
    turn = rotation(dims)
    centroids = fit_centroids(sample, max(1, min(MOST_LISTS, n // LIST_ROWS)))
    probes = calibrated_probes(sample, centroids, k, recall)
    lists = len(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                x = part.column(1).flatten().to_numpy().reshape(-1, dims)
                near = _squared(x, centroids).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "list", "v"])

    rows = checkpointed(v.mapInArrow(assign, "id long, list int, v binary"))
    queries = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))

    count = np.zeros(lists, np.int64)  # at most MOST_LISTS numbers
    for r in rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        count[r["list"]] = r["n"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                x = np.frombuffer(b"".join(part.column(1).to_pylist())).reshape(-1, dims)
                order = _squared(x, centroids).argsort(1)
                # First the nearest lists that hold enough rows for k neighbours; then on to as many as calibrated.
                reach = np.cumsum(count[order], axis=1) - count[order]
                near = reach < 4 * (k + 1)
                lists_of = lambda chosen: pa.array([o[c].astype(np.int32) for o, c in zip(order, chosen)], pa.list_(pa.int32()))
                more = (np.arange(lists)[None] < probes) & ~near
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists_of(near), lists_of(more)], ["id", "v", "near", "more"])

    asked = checkpointed(queries.mapInArrow(probe, "id long, v binary, near array<int>, more array<int>"))
    out = "query_id long, id long, score double"

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            vectors = [np.frombuffer(b"".join(t.column("v").to_pylist())).reshape(-1, dims) for t in (a, b)]
            found = list(scan(*vectors, a.column("id").to_numpy(), b.column("id").to_numpy(), turn, k, b.column("most").to_numpy()))
        cols = list(zip(*found)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    def scanned(asked: DataFrame) -> DataFrame:
        """``out`` of the queries (id, v, most, list). A list of many rows or queries is dealt out to a grid of tasks, each
        with bounded rows and queries."""
        many = np.zeros(lists, np.int64)
        for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
            many[r["list"]] = r["n"]
        grid = lambda n, most: F.element_at(F.array(*[F.lit(int(max(1, -(-x // most)))) for x in n]), F.col("list") + 1)
        part = lambda cells: F.pmod(F.xxhash64("id", "v"), cells).cast("int")
        every = lambda cells: F.explode(F.sequence(F.lit(0), cells - 1))
        wanted = F.array(*[F.lit(bool(n)) for n in many])
        left = rows.where(F.element_at(wanted, F.col("list") + 1)).withColumn("row_part", part(grid(count, CHUNK_ROWS))).withColumn("query_part", every(grid(many, CHUNK_QUERIES)))
        right = asked.withColumn("query_part", part(grid(many, CHUNK_QUERIES))).withColumn("row_part", every(grid(count, CHUNK_ROWS)))
        cell = ("list", "row_part", "query_part")
        return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, out)

    best = Window.partitionBy("query_id").orderBy("score", "id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = checkpointed(top(scanned(asked.select("id", "v", F.lit(float("inf")).alias("most"), F.explode("near").alias("list")))))
    known = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("most"))
    rest = asked.join(known, "id", "left").select("id", "v", F.coalesce("most", F.lit(float("inf"))).alias("most"), F.explode("more").alias("list"))
    found = first.select("query_id", "id", "score").union(scanned(checkpointed(rest)))
    return top(found).select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
