"""Mixing sources to target weights by a time-varying curriculum.

Each source draws words at a rate that changes over the training time 0..1. The integral of the rate is
the source's cumulative demand; the documents of a source, in a fixed shuffled order, supply words; the
position of a document is the time at which demand reaches the middle of its words, found by inverting
the integral. Documents are then range-sorted by position.

The cumulative supply is a two-level prefix sum: buckets of the shuffled order are summed first, so that
no source, however large, is summed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, row_digests

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of the shuffled order of each source: the first hex digits of the order's hash.
BUCKET_DIGITS = 3
#: Bytes of text, about, in a range of positions of the mixed documents.
RANGE_BYTES = 32 << 20
#: A source's name that is never null and so joins.
KEY = "coalesce(concat('s', source), '')"


def _ahead(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` with ``sums`` over the rows that come before in ``order``: within ranges of it, and over whole ranges, so that no
    task sees all rows."""
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.unboundedPreceding, -1
    whole = dealt.groupBy("__part").agg(*[F.sum(x).alias(f"__{c}") for c, x in sums.items()])
    by_part = Window.orderBy("__part").rowsBetween(*before)  # a row for each range
    whole = whole.select("__part", *[F.coalesce(F.sum(f"__{c}").over(by_part), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(*before)
    out = dealt.withColumns({c: F.coalesce(F.sum(x).over(inside), F.lit(0)) for c, x in sums.items()}).join(whole, "__part")
    return out.withColumns({c: F.col(c) + F.col(f"__{c}") for c in sums}).drop("__part", *[f"__{c}" for c in sums])


def target_words(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with weight, target and ramp.

    Sources in code point order, null last, take the weights in turn. Together they get ``share`` times
    all words, by weight; no target exceeds ``most`` times its source, and what that frees is dealt out
    again by weight. That ends where a level L gives min(weight * L, cap) to each source, and the sum of
    these is the share: with sources in order of cap/weight, the first k are capped, and L is what is
    left over the weight that is left, for the least k at which the next source stays below its cap.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    t = _ahead(sizes, [F.col("source").asc_nulls_last()], place=F.lit(1))
    t = t.withColumn("weight", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = _ahead(t.drop("place"), [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], capped=F.col("cap"), lighter=F.col("weight"))
    total = t.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).head()
    level = (F.lit((total["size"] or 0) * float(share)) - F.col("capped")) / (F.lit(total["weight"] or 0.0) - F.col("lighter"))
    fits = t.select((F.col("cap") / F.col("weight")).alias("reach"), "lighter", level.alias("level"), "weight", "cap").where("level * weight <= cap")
    found = fits.agg(F.min(F.struct("reach", "lighter", "level")).alias("first")).head()["first"]  # of equal reaches the first
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.lit(found["level"]) * F.col("weight"))
    heaviest = F.lit(float(max(weights)))
    return t.select("source", "source_size", "weight", target.alias("target"), (F.lit(0.5) - F.col("weight") / heaviest).alias("ramp"))


def position(u: Column, ramp: Column) -> Column:
    """The time at which a rate of 1 + ramp * (2t - 1), -1 < ramp < 1, has integrated to ``u``."""
    root = F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u)
    return F.when(F.abs(ramp) < 1e-9, u).otherwise((root - (1 - ramp)) / (2 * ramp))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """(doc_id, source, size, hash, bucket, key, *more): all that the mix is decided on, without texts, computed once."""
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("hash"),
        *more,
    )
    return checkpointed(d.withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS)).withColumn("key", F.expr(KEY)))


def _placed(d: DataFrame, weights, share: float, most: float) -> DataFrame:
    """``d`` from :func:`_slim`, in no order, with source_size, target, middle, times and positions."""
    buckets = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    targets = target_words(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    plan = offsets.withColumn("key", F.expr(KEY)).drop("source").join(targets.withColumn("key", F.expr(KEY)), "key").select("key", "bucket", "offset", "source_size", "target", "ramp")
    inside = Window.partitionBy("key", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(plan, ["key", "bucket"])  # dealt out as for the window: only the plan moves
    middle = F.col("offset") + F.col("within") + F.col("size") / 2.0
    at = [middle + F.col("source_size") * c for c in range(int(most + 1))]
    positions = F.filter(F.array(*[F.when(x < F.col("target"), position(x / F.col("target"), F.col("ramp"))) for x in at]), lambda x: x.isNotNull())
    return d.withColumn("positions", positions).withColumn("times", F.size("positions").cast("long"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, times, positions.

    size counts words (null text: 0). A document is taken whole, ``times`` times; pass c of a source takes
    it if the middle of its words, counted from c source sizes on, lies before the target, so a source
    misses its target by half a document at most. positions are the times in 0..1 at which the source's demand reaches
    that middle, one for each pass: the passes of a document lie one source size of demand apart. The shuffled order is by
    MD5 of the id, then id, size and source; rows equal in all of these are interchangeable, so reruns agree. A null id has an
    order like any other; a null source is a source of its own. Documents without words take part with 0
    words. The rows are range-sorted by their first position, those not taken last. Other columns are ignored. An
    empty table gives an empty result.
    """
    d = _placed(_slim(docs, id_col, text_col, source_col), weights, share, most)
    out = d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "positions", F.col("hash").alias("_hash"))
    # The hash deals those not taken, which have no position, to many ranges.
    return out.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "_hash").drop("_hash")


def mixed_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it, every copy at its own position; same columns.

    The mix is decided on rows without texts, told apart by 128 bits of all their columns, and its copies are dealt to ranges of
    positions, each for about ``RANGE_BYTES`` of text. Texts are then moved twice: to meet their copies, and to their ranges.
    Rows equal in all columns are interchangeable: one of them meets the copies of all.
    """
    k1, k2 = row_digests(docs)
    d = _placed(_slim(docs, id_col, text_col, source_col, k1.alias("k1"), k2.alias("k2")), weights, share, most).where("times > 0")
    equal = d.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    copies = d.select("k1", "k2", "hash", "size", F.posexplode("positions").alias("pass", "position")).join(equal, ["k1", "k2"])
    copies = checkpointed(copies)
    words = copies.agg(F.sum("size")).head()[0]
    if words is None:
        return docs.limit(0)
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, words * 8 // RANGE_BYTES)
    seats = checkpointed(copies.repartitionByRange(int(ranges), "position", "hash", "pass").withColumn("range", F.spark_partition_id()).drop("size"))
    ranges = seats.agg(F.max("range")).head()[0] + 1
    # Names that docs can't clash with: its columns travel in a struct.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    seated = keyed.join(seats.where("n = 1"), ["k1", "k2"])
    several = seats.where("n > 1")
    if not several.isEmpty():
        one = keyed.join(several.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.any_value("row").alias("row"))
        seated = seated.unionByName(one.join(several, ["k1", "k2"]))
    ordered = seated.repartitionById(ranges, F.col("range")).sortWithinPartitions("position", "hash", "pass")
    return ordered.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
