"""Exact dedup of whole texts: local, salted and global combining, full content compared at every stage.

1. Local: the map-side half of the first aggregation keeps one row for each digest, salt and text of a task.
2. Salted: the survivors of one digest meet in ``salts`` groups, so a text that fills a third of
   the table never meets in one task.
3. Global: the at most ``salts`` winners of a text meet.

Every stage groups by digest *and* text, so a collision of digests can't join two texts. Only the
winners, without their texts, are joined back to the rows: on the digest alone where the digest
has a single text, which stage 3 has verified, and on digest and text in the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed

SALTS = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=None) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z only; of equal texts the row with
    the largest id stays. Null and empty texts are equal. Rows that repeat an id count each; all of them
    are kept if theirs is the largest id. A null id is smaller than any other; in a group of null ids
    only, keep_id is null and every row is kept. An empty table gives an empty result. Other columns of
    ``docs`` are ignored. ``digest`` (a function of the normalised text) is there for tests.
    """
    sha: Column = F.sha2(F.col("norm"), 256)
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    rows = rows.select("id", "norm", (digest(F.col("norm")) if digest else F.unhex(sha)).alias("digest"))
    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    best = (F.max("top").alias("top"), F.sum("n").alias("n"))
    salted = rows.groupBy("digest", salt.alias("salt"), "norm").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "norm").agg(*best)
    per_digest = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("top").alias("top"), F.max("n").alias("n"))
    per_digest = checkpointed(per_digest)  # a plain table, so that AQE can split a digest with very many rows in the join below
    slim = rows.select("id", "digest", sha.alias("text_sha256")) if digest else rows.select("id", "digest", F.lower(F.hex("digest")).alias("text_sha256"))
    joined = slim.join(per_digest.where("texts = 1").drop("texts"), "digest")
    collided = per_digest.where("texts > 1").select("digest")
    if not collided.isEmpty():
        texts = salted.join(collided, "digest", "left_semi").groupBy("digest", "norm").agg(*best)
        clash = rows.withColumn("text_sha256", sha).join(collided, "digest", "left_semi").join(texts, ["digest", "norm"])
        joined = joined.unionByName(clash.select(joined.columns))
    return joined.select(
        F.col("id").alias(id_col),
        F.col("top").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("top")).alias("kept"),
        "text_sha256",
    )
