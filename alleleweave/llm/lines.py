"""Line dedup with sharded cuckoo filters backed by exact reference-count tables.

The reference table counts, for every line key and document, how often the document holds the line; from it
follow how many documents hold a key and which is the largest. Inserting documents adds to the
counts, deleting them takes from the counts, so the index after a deletion equals one that never saw the
documents. The keys that are due for removal stand in cuckoo filters, one for each shard of the keys:
two possible buckets for a key's 16-bit fingerprint, so a key can be taken out again. The filters are part of the
index: keys that become due by an insertion are put into them, keys that cease to be due by a deletion are taken
out, and a filter that gets too full is built anew from the exact table. A line is looked up
in its shard's filter; only possible hits go on to the exact table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, checkpointed, release

LEAST_LENGTH = 40
LEAST_DOCS = 5
SHARDS = 16
#: Keys of a shard, and lines of a shard and salt, that one task holds, about.
SHARD_KEYS = 500_000
SLOTS = 4
MOST_KICKS = 500


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def digest(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


class CuckooFilter:
    """Fingerprints of 64-bit hashes in buckets of four; grows by building anew, so an insert never fails."""

    def __init__(self, keys: np.ndarray | None = None) -> None:
        self.keys = 0
        self._reset(max(1, 0 if keys is None else len(keys)))
        if keys is not None:
            while not self._fill(keys):
                self._reset(2 * len(self.table) * SLOTS)

    @classmethod
    def read(cls, table: bytes) -> CuckooFilter:
        out = cls()
        out.table = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
        out.keys = int((out.table != 0).sum())
        return out

    def written(self) -> bytes:
        return self.table.tobytes()

    def contents(self) -> list[tuple[int, int]]:
        """What the filter holds, wherever it stands: each fingerprint with the lesser of its two buckets."""
        b, c = np.nonzero(self.table)
        f = self.table[b, c].astype(np.int64)
        return sorted(zip(f.tolist(), np.minimum(b, self._other(f, b)).tolist()))

    def _reset(self, n: int) -> None:
        self.table = np.zeros((1 << max(1, int(n / SLOTS / 0.8)).bit_length(), SLOTS), np.uint16)

    def _fill(self, keys: np.ndarray) -> bool:
        self.keys = 0
        return all(self._put(int(f), int(b)) for f, b in zip(*self._of(keys)))

    def _of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        return (keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1), keys & np.uint64(len(self.table) - 1)

    def _other(self, f, b):
        return (b ^ (f * 0x5BD1E995)) & (len(self.table) - 1)

    def _put(self, f: int, b: int) -> bool:
        for k in range(MOST_KICKS):
            for c in (b, self._other(f, b)):
                free = np.flatnonzero(self.table[c] == 0)
                if len(free):
                    self.table[c, free[0]] = f
                    self.keys += 1
                    return True
            s = k % SLOTS
            f, self.table[c, s] = int(self.table[c, s]), f
            b = self._other(f, c)
        return False

    def insert(self, key: int) -> bool:
        """False if the filter is too full: build it anew from the exact table."""
        f, b = self._of(np.array([key], np.uint64))
        return self._put(int(f[0]), int(b[0]))

    def delete(self, key: int) -> bool:
        """Takes out one copy of a key that was inserted."""
        f, b = (int(x[0]) for x in self._of(np.array([key], np.uint64)))
        for c in (b, self._other(f, b)):
            at = np.flatnonzero(self.table[c] == f)
            if len(at):
                self.table[c, at[0]] = 0
                self.keys -= 1
                return True
        return False

    def might_contain(self, keys: np.ndarray) -> np.ndarray:
        f, b = self._of(keys)
        other = (b ^ (f * np.uint64(0x5BD1E995))) & np.uint64(len(self.table) - 1)
        f = f.astype(np.uint16)[:, None]
        return (self.table[b.astype(np.int64)] == f).any(1) | (self.table[other.astype(np.int64)] == f).any(1)


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """(k1, k2, doc, n): the 128-bit key of every line of ``least_length`` code points or more, and how often
    the document holds it."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                doc, k1, k2 = [], [], []
                for i, t in enumerate(part.column(1)):
                    for line in (t.as_py() or b"").split(b"\n"):
                        if len(line) >= least_length and _long_enough(key := line_key(line), least_length):
                            a, b = digest(key)
                            doc.append(i)
                            k1.append(a)
                            k2.append(b)
                longs = [pa.array(np.array(k, np.uint64).view(np.int64)) for k in (k1, k2)]
                yield pa.RecordBatch.from_arrays([*longs, part.column(0).take(pa.array(doc, pa.int64()))], ["k1", "k2", "doc"])
        release()

    found = docs.selectExpr(f"`{id_col}` AS doc", f"CAST(`{text_col}` AS BINARY) AS text").mapInArrow(run, f"k1 long, k2 long, doc {kind}")
    return found.groupBy("k1", "k2", "doc").agg(F.count(F.lit(1)).alias("n"))


def due(refs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(k1, k2, docs, keeper): the keys that ``least_docs`` documents or more hold, and the largest of these."""
    return refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= least_docs)


def _shard(shards: int) -> Column:
    return F.pmod("k1", F.lit(shards)).cast("int")


FILTERS = "shard int, filter binary"


def _built(keys: DataFrame, shards: int) -> DataFrame:
    """FILTERS of the keys (k1), one for each shard that has any."""

    def build(table: pa.Table) -> pa.Table:
        made = CuckooFilter(table.column("k1").to_numpy().view(np.uint64)).written()
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([made], pa.binary())})

    return keys.select("k1", _shard(shards).alias("shard")).groupBy("shard").applyInArrow(build, FILTERS)


class LineIndex:
    """An incremental index: the exact reference table, to which documents are added and from which they are taken, and
    the filters of the keys that are due."""

    def __init__(self, refs: DataFrame, filters: DataFrame, shards: int, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> None:
        self.refs, self.filters, self.shards, self.least_length, self.least_docs = refs, filters, shards, least_length, least_docs
        self._due: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> LineIndex:
        refs = references(docs, id_col, text_col, least_length)
        exact = checkpointed(due(refs, least_docs))
        shards = max(SHARDS, exact.count() // SHARD_KEYS)
        index = cls(refs, checkpointed(_built(exact, shards)), shards, least_length, least_docs)
        index._due = exact
        return index

    @property
    def due(self) -> DataFrame:
        """(k1, k2, docs, keeper) of the keys that are due, computed once."""
        if self._due is None:
            self._due = checkpointed(due(self.refs, self.least_docs))
        return self._due

    def _with(self, docs: DataFrame, sign: int, id_col: str, text_col: str) -> LineIndex:
        more = checkpointed(references(docs, id_col, text_col, self.least_length).withColumn("n", F.col("n") * sign))
        refs = self.refs.unionByName(more).groupBy("k1", "k2", "doc").agg(F.sum("n").alias("n")).where("n > 0")
        refs = checkpointed(refs)
        # Only keys of these documents can become due or cease to be.
        touched = more.select("k1", "k2").distinct()
        before, after = (due(r.join(touched, ["k1", "k2"], "left_semi"), self.least_docs).select("k1", "k2") for r in (self.refs, refs))
        changes = after.join(before, ["k1", "k2"], "left_anti").withColumn("put", F.lit(True)).union(before.join(after, ["k1", "k2"], "left_anti").withColumn("put", F.lit(False)))

        def update(old: pa.Table, changed: pa.Table) -> pa.Table:
            shard = (old if old.num_rows else changed).column("shard")[0].as_py()
            f = CuckooFilter.read(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter()
            put, keys = changed.column("put").to_numpy(zero_copy_only=False), changed.column("k1").to_numpy().view(np.uint64)
            fits = all(f.delete(int(k)) for k in keys[~put]) and all(f.insert(int(k)) for k in keys[put])
            return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([f.written() if fits else None], pa.binary())})

        changes = changes.select("k1", "put", _shard(self.shards).alias("shard"))
        filters = checkpointed(self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(update, FILTERS))
        index = LineIndex(refs, filters, self.shards, self.least_length, self.least_docs)
        full = filters.where("filter IS NULL").select("shard")
        if not full.isEmpty():
            anew = _built(index.due.join(full, _shard(self.shards) == full.shard, "left_semi"), self.shards)
            index.filters = checkpointed(filters.where("filter IS NOT NULL").union(anew))
        return index

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return self._with(docs, 1, id_col, text_col)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Takes ``docs`` out, whose texts must be those that were inserted."""
        return self._with(docs, -1, id_col, text_col)

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
        """One row per row of ``docs``: id_col, text without the lines that are due, n_lines, n_dropped, ``keep``.

        Keys that enough documents hold lose all their lines except in the largest document that holds them;
        there all stay. A null or empty text is one empty line. A null id is a document like any other, smaller
        than the rest, and all rows with null ids are that document, as all rows with one id are one. Other
        columns are ignored; an empty table gives an empty result. The filters and the due keys are broadcast if they take at
        most ``broadcast_bytes``; else each shard of the filters meets its share of the lines in a shuffle.
        """
        filters = self.filters.agg(F.sum(F.length("filter"))).head()[0] or 0
        if self.due.count() * 48 + filters <= broadcast_bytes:
            return _apply_broadcast(docs, self, id_col, text_col, keep)
        return _apply_sharded(docs, self, id_col, text_col, keep)


class Due:
    """A filter and an exact table for each shard."""

    def __init__(self, shards: int, filters: dict[int, bytes], k1: np.ndarray, k2: np.ndarray, keeper: list) -> None:
        self.shards, self.filters = shards, {s: CuckooFilter.read(f) for s, f in filters.items()}
        self.exact = {(int(a), int(b)): k for a, b, k in zip(k1, k2, keeper)}

    def keepers(self, keys: list[tuple[int, int]]) -> dict[int, object]:
        """For each of ``keys`` that is due: its place in the list, and its largest document."""
        k1 = np.fromiter((a for a, _ in keys), np.uint64, len(keys))
        shard, out = k1.view(np.int64) % self.shards, {}
        for s in np.unique(shard):
            if int(s) in self.filters:
                at = np.flatnonzero(shard == s)
                for i in at[self.filters[int(s)].might_contain(k1[at])]:
                    if keys[i] in self.exact:
                        out[int(i)] = self.exact[keys[i]]
        return out


def _slim(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, str]:
    """(id, rest, text) of ``docs``, and the schema of :func:`_rewritten`; rest has the columns to keep."""
    rest = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)])
    slim = docs.select(F.col(id_col).alias("id"), rest.alias("rest"), F.col(text_col).cast("binary").alias("text"))
    kinds = [slim.schema[c].dataType.simpleString() for c in ("id", "rest")]
    return slim, "id {}, rest {}, text string, n_lines long, n_dropped long".format(*kinds)


def _rewritten(part: pa.RecordBatch, keepers_of, least_length: int) -> pa.RecordBatch:
    """id, rest, text, n_lines, n_dropped of a batch (id, rest, text); ``keepers_of`` maps keys to what is due of them."""
    ids, texts = part.column(0).to_pylist(), [(t.as_py() or b"").split(b"\n") for t in part.column(2)]
    where, keys = [], []
    for i, lines in enumerate(texts):
        for j, line in enumerate(lines):
            if len(line) >= least_length and _long_enough(key := line_key(line), least_length):
                where.append((i, j))
                keys.append(digest(key))
    dropped = [0] * len(ids)
    for at, keeper in keepers_of(keys).items():
        i, j = where[at]
        if ids[i] != keeper:
            texts[i][j] = None
            dropped[i] += 1
    kept = [b"\n".join(x for x in lines if x is not None).decode() for lines in texts]
    counts = [pa.array(x, pa.int64()) for x in ([len(x) for x in texts], dropped)]
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(kept, pa.string()), *counts], ["id", "rest", "text", "n_lines", "n_dropped"])


def _named(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    kept = [F.col(f"rest.k{n}").alias(c) for n, c in enumerate(keep)]
    return df.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_lines", "n_dropped", *kept)


def _apply_broadcast(docs: DataFrame, index: LineIndex, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    rows = index.due.select("k1", "k2", "keeper").collect()  # the caller has counted them, and the bytes of the filters
    filters = {r["shard"]: bytes(r["filter"]) for r in index.filters.collect()}
    k1, k2 = (np.array([r[i] for r in rows], np.int64).view(np.uint64) for i in (0, 1))
    shared = docs.sparkSession.sparkContext.broadcast(Due(index.shards, filters, k1, k2, [r[2] for r in rows]))
    least_length = index.least_length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                yield _rewritten(batch.slice(start, 512), shared.value.keepers, least_length)
        release()

    slim, schema = _slim(docs, id_col, text_col, keep)
    return _named(slim.mapInArrow(run, schema), id_col, text_col, keep)


def _apply_sharded(docs: DataFrame, index: LineIndex, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The same without a broadcast: each shard's lines meet its filter, what passes meets the exact table, and the
    lines to drop meet their documents by id. A shard's lines are salted by document, its filter goes to each salt."""
    kind = docs.schema[id_col].dataType.simpleString()
    exact, least_length = index.due, index.least_length
    refs = checkpointed(references(docs, id_col, text_col, least_length))
    salts = max(1, refs.count() // index.shards // SHARD_KEYS)
    shard, salt = _shard(index.shards).alias("shard"), F.pmod(F.xxhash64("doc"), F.lit(salts)).alias("salt")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")

    def probe(lines: pa.Table, filters: pa.Table) -> pa.Table:
        passed = np.zeros(lines.num_rows, bool)
        if lines.num_rows and filters.num_rows:
            passed = CuckooFilter.read(filters.column("filter")[0].as_py()).might_contain(lines.column("k1").to_numpy().view(np.uint64))
        return lines.select(["k1", "k2", "doc"]).filter(pa.array(passed))

    left = refs.select("k1", "k2", "doc", shard, salt).groupBy("shard", "salt")
    right = index.filters.select("shard", "filter", copies).groupBy("shard", "salt")
    possible = left.cogroup(right).applyInArrow(probe, f"k1 long, k2 long, doc {kind}")
    drop = possible.join(exact.select("k1", "k2", "keeper"), ["k1", "k2"]).where("NOT (doc <=> keeper)")
    drop = drop.groupBy("doc").agg(F.collect_set(F.struct("k1", "k2")).alias("drop"))  # at most the lines of one document
    slim, schema = _slim(docs, id_col, text_col, keep)
    joined = slim.join(drop, F.col("id").eqNullSafe(F.col("doc")), "left").select("id", "rest", "text", "drop")
    gone = "gone"  # no id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(batch.num_rows):
                part = batch.slice(start, 1)
                keys = {(x["k1"] % (1 << 64), x["k2"] % (1 << 64)) for x in part.column(3)[0].as_py() or ()}
                yield _rewritten(part, lambda found, keys=keys: {i: gone for i, k in enumerate(found) if k in keys}, least_length)

    return _named(joined.mapInArrow(run, schema), id_col, text_col, keep)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` indexed and rewritten: see :meth:`LineIndex.apply`."""
    return LineIndex.of(docs, id_col, text_col, least_length, least_docs).apply(docs, id_col, text_col, keep=keep)
