"""Near copies by the exact Jaccard similarity of word shingles.

Candidates come from two searches over distinct sets of shingles: bands of minimum hashes, which lose a pair at a
similarity of 0.8 with a chance of 0.0004, and SimHash fingerprints within 3 bits. Every link is then verified on
the sets themselves. Members of a bucket are first compared with one of them, the hub, in a large bucket with a few, which
ties most of a large group together. Whatever is still apart is compared pair by pair, in a large bucket
all pairs that share one of their rarest shingles, as every pair alike enough does: so no candidate is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import checkpointed, free_shuffles, release, row_digests
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at similarity s meets in a bucket with a chance of 1 - (1 - s ** ROWS) ** BANDS.
BANDS, ROWS = 20, 5
#: Buckets of up to so many texts have one hub, and what is still apart then is compared pair by pair; larger ones have so
#: many hubs, and what is still apart is compared by its rarest shingles.
SMALL, HUBS = 32, 6
#: Bits of a shingle that are compared first.
CODE = 16
CHUNK = 2048
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def node_of(distinct: np.ndarray) -> int:
    """64 bits that tell sets of shingles (sorted hashes) apart."""
    return xxhash.xxh3_64_intdigest(distinct.tobytes())


def bands(distinct: np.ndarray) -> list[int]:
    """The keys of the buckets that a set of shingles falls into; none for an empty set."""
    if not len(distinct):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(distinct), CHUNK):
        np.minimum(least, (FACTORS[:, None] * distinct[None, start : start + CHUNK]).min(1), out=least)
    return [simhash.signed(xxhash.xxh3_64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)]


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, t, rest, node, fp, bands): a row for each row of ``docs``. t is a hash of the text, node one of its shingles,
    rest has the columns to keep."""
    rest = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)])
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), rest.alias("rest"), F.col(text_col).cast("binary").alias("text"))
    kinds = [slim.schema[c].dataType.simpleString() for c in ("id", "rest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, keys = [], [], []
            for text in batch.column(3):
                h = simhash.shingle_hashes(text.as_py(), shingle)
                distinct = np.unique(h)
                node.append(simhash.signed(node_of(distinct)))
                fp.append(simhash.signed(simhash.folded(h)))
                keys.append(bands(distinct))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "t", "rest", "node", "fp", "bands"])
        release()

    return slim.mapInArrow(run, "id {}, t long, rest {}, node long, fp long, bands array<long>".format(*kinds))


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, n, codes, shingles): the sets of the texts whose hash is in ``wanted`` (t), one row for each; n shingles, and the
    different ``CODE`` bits of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            node, sets, codes = [], [], []
            for text in batch.column(0):
                distinct = np.unique(simhash.shingle_hashes(text.as_py(), shingle))
                n = simhash.signed(node_of(distinct))
                if n not in seen:
                    seen.add(n)
                    node.append(n)
                    sets.append(distinct.view(np.int64))
                    codes.append(np.unique((distinct & np.uint64((1 << CODE) - 1)).astype(np.uint16).view(np.int16)))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(codes, pa.list_(pa.int16())), pa.array(sets, pa.list_(pa.int64()))], ["node", "n", "codes", "shingles"])
        release()

    texts = docs.select(F.xxhash64(text_col).alias("t"), F.col(text_col).cast("binary").alias("text")).join(wanted, "t", "left_semi")
    return texts.select("text").mapInArrow(run, "node long, n int, codes array<short>, shingles array<long>").groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("n", "codes", "shingles")])


def jaccard(x: Column, y: Column) -> Column:
    common = F.size(F.array_intersect(x, y))
    return common / (F.size(x) + F.size(y) - common)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have a Jaccard similarity of ``similarity`` at least.

    The sets' codes come first, a quarter of their bytes: as many shingles as are common at most as codes are, and as either
    set has shingles beyond its codes. Only pairs that could be alike by that bring their sets together.
    """

    def both(pairs: DataFrame, *columns: str) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ab")
        # The hub is joined last: its side is the one with repeated keys.
        return pairs.join(b, "b").join(a, "a")

    spare = F.least(F.col("n_a") - F.size("codes_a"), F.col("n_b") - F.size("codes_b"))
    most = F.size(F.array_intersect("codes_a", "codes_b")) + spare
    possible = both(pairs, "n", "codes").where(most >= F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-9).select("a", "b")
    return both(possible, "shingles").where(jaccard(F.col("shingles_a"), F.col("shingles_b")) >= similarity).select("a", "b")


def rare_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, root) under different roots that may be alike, none that is left out.

    Two sets with a Jaccard similarity of s have s / (1 + s) * (n + m) shingles in common, and so one of the n - ceil(s * n) + 1
    of either that come first in any common order; the first one that they share, with what comes after it in
    either, must still make up that number. Here the rarest among ``nodes`` come first, so that a passage which many texts share
    makes no pairs.
    """
    each = sets.join(nodes, "node").select("node", "root", "n", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    first = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9) + 1
    shared = each.join(often, "shingle").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("s"))  # of one text
    alone = F.col("n") - F.size("s")  # shingles that no other node has come before all others
    keyed = shared.select("node", "root", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), F.greatest(F.lit(0), (first - alone).cast("int")))).alias("at", "k"))
    keyed = checkpointed(keyed.select("node", "root", (F.col("n") - F.col("alone") - F.col("at") - 1).alias("after"), "n", F.col("k.shingle").alias("key")))
    a, b = (keyed.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "n", "after")]) for side in "ab")
    common = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-9
    near = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(similarity) - 1e-9) & (F.least("after_a", "after_b") + 1 >= common)
    return a.join(b, "key").where(near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id_col, node (long), root (long, one for each group), component_id, and ``keep``.

    component_id is the least id reachable by links between texts of which the sets of ``shingle`` words (all words
    of a shorter text) have a Jaccard similarity of ``similarity`` or more. Words are parted by ASCII white space,
    A-Z lower-cased. Texts without words are copies of each other. Rows with equal ids each get a row; a null id
    never is a component_id unless its component has no other. An empty table gives an empty result.
    """
    each = checkpointed(sketches(docs, id_col, text_col, shingle, keep))
    nodes = checkpointed(each.groupBy("node").agg(F.min("id").alias("least"), F.min("t").alias("t"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))
    worded = nodes.where(F.size("bands") > 0)
    keyed = worded.select("node", F.explode("bands").alias("key"))
    # Hubs by the same few orders of all nodes, so that buckets of one group mostly have the same ones.
    hubs = [F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(HUBS)]
    n = F.count(F.lit(1))
    shared = keyed.groupBy("key").agg(n.alias("n"), F.when(n > SMALL, F.array_distinct(F.array(*hubs))).otherwise(F.array(hubs[0])).alias("hubs")).where("n > 1").select("key", "hubs")
    keyed = checkpointed(keyed.join(shared, "key"))
    by_fp = worded.groupBy("fp").agg(F.min("node").alias("hub"))
    close = simhash.links(worded.select("fp").distinct())
    ends = [by_fp.select(F.col("fp").alias(c), F.col("hub").alias(f"hub_{c}")) for c in ("a", "b")]
    prints = worded.join(by_fp, "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    prints = prints.union(close.join(ends[0], "a").join(ends[1], "b").select("hub_a", "hub_b"))
    # The same hub in most buckets of a group: few different pairs.
    pairs = checkpointed(prints.union(keyed.select(F.explode("hubs").alias("hub"), "node").where("node <> hub")).distinct())
    members = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = checkpointed(shingle_sets(docs, worded.join(members, "node", "left_semi").select("t").distinct(), text_col, shingle))
    free_shuffles(docs.sparkSession)  # here and below: each step's files are as large as the next one's
    links = checkpointed(verified(pairs, sets, similarity))
    free_shuffles(docs.sparkSession)
    roots = checkpointed(components(links))
    free_shuffles(docs.sparkSession)
    # What is left are buckets whose members are not all in one component.
    of = keyed.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = of.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    left = checkpointed(of.join(mixed.select("key", "n"), "key"))
    large = left.where(F.col("n") > SMALL)
    one, two = (left.where(F.col("n") <= SMALL).select("key", F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
    pairs = one.join(two, "key").where("root_a <> root_b AND a < b").select("a", "b")
    if not large.isEmpty():
        pairs = pairs.union(rare_pairs(large.select("node", "root").distinct(), sets, similarity))
    pairs = checkpointed(pairs.distinct())
    free_shuffles(docs.sparkSession)
    found = checkpointed(verified(pairs, sets, similarity))
    free_shuffles(docs.sparkSession)
    if not found.isEmpty():
        roots = checkpointed(components(links.union(found)))
        free_shuffles(docs.sparkSession)
    named = checkpointed(nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(best, "root").select("node", "root", "component_id")
    return each.join(of, "node").select(F.col("id").alias(id_col), "node", "root", "component_id", *[F.col(f"rest.k{k}").alias(c) for k, c in enumerate(keep)])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay of its groups of near copies, one row of each: that with the least id, null ids
    last; of equal ids one chosen by a hash of the whole row. Same columns."""
    k1, k2 = row_digests(docs)
    names = ("__k1", "__k2")
    groups = similar_groups(docs.select("*", k1.alias(names[0]), k2.alias(names[1])), id_col, text_col, shingle, similarity, names)
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), *names)).alias("first")
    stay = groups.groupBy("root").agg(first).select("first.__k1", "first.__k2")
    equal = groups.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    stay = checkpointed(stay.join(equal, list(names)))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1.alias(names[0]), k2.alias(names[1]))
    out = keyed.join(stay.where("n = 1"), list(names), "left_semi").select("row")
    several = stay.where("n > 1")
    if not several.isEmpty():
        out = out.union(keyed.join(several, list(names), "left_semi").groupBy(*names).agg(F.any_value("row").alias("row")).select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
