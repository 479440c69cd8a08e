"""Filters of variant tables (rec_no, chrom, pos, ref, alts, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alleleweave.model import Region


def in_region(variants: DataFrame, region: Region | None, overlapping: bool = False) -> DataFrame:
    """Records that start in the region; with ``overlapping`` also those that begin before it and reach in.

    The bounds stand on bare columns, so a columnar source can skip by them.
    """
    if region is None:
        return variants
    here = (F.col("chrom") == region.chrom) & (F.col("pos") <= region.end)
    if not overlapping:
        return variants.where(here & (F.col("pos") >= region.start))
    return variants.where(here & (F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1 >= region.start))


def looks_like_snv(ref: Column = None, alts: Column = None) -> Column:
    """One reference character and one alternate of one character, whatever they are."""
    ref, alts = F.col("ref") if ref is None else ref, F.col("alts") if alts is None else alts
    return (F.length(ref) == 1) & (F.size(alts) == 1) & (F.length(F.get(alts, F.lit(0))) == 1)


def is_biallelic_snv(ref: Column = None, alts: Column = None) -> Column:
    """As :func:`looks_like_snv`, and the alternate is another base, neither missing nor a deleted allele."""
    ref, alts = F.col("ref") if ref is None else ref, F.col("alts") if alts is None else alts
    alt = F.get(alts, F.lit(0))
    return looks_like_snv(ref, alts) & ~alt.isin(".", "*") & (F.upper(alt) != F.upper(ref))


def biallelic_snvs(variants: DataFrame) -> DataFrame:
    return variants.where(is_biallelic_snv())


def drop_duplicate_positions(variants: DataFrame) -> DataFrame:
    """Without any record whose position has more than one: none of them stays.

    A window, not an aggregate and a join: one shuffle, and no column has to be carried through an aggregate.
    """
    at = Window.partitionBy("chrom", "pos")
    return variants.withColumn("_n", F.count(F.lit(1)).over(at)).where("_n = 1").drop("_n")


def duplicate_positions(variants: DataFrame) -> DataFrame:
    """(chrom, pos, n) of positions with more than one record."""
    return variants.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def encodable(variants: DataFrame, region: Region | None = None) -> DataFrame:
    """What can be encoded: in the region, biallelic SNVs, and alone at their position among these."""
    return drop_duplicate_positions(biallelic_snvs(in_region(variants, region)))
