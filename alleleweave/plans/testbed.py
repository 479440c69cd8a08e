"""A synthetic cohort made of the driver's tables by plain arithmetic, so that SQL can make the same one.

It grows with them: every line of lineitem is a record, every supplier a sample, and part is the reference of each contig.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alleleweave.model import Region
from alleleweave.operators import sinks
from alleleweave.operators.encode import BROADCAST_BYTES

CONTIG = "chr1"
#: Genotypes by the remainder of a mixing formula: with missing and unphased calls, and phased only.
MIXED = ("0|0", "0|1", "1|0", "1|1", "./.", "0/1", ".|1")
PHASED = MIXED[:4]
#: Order keys whose records are numbered together, and positions of a piece of reference.
NUMBERED, PIECE = 1 << 14, 1000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(number: Column) -> Column:
    return F.substr(F.lit("ACGT"), (number % 4).cast("int") + 1, F.lit(1))


def variants(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """(chrom, pos, rec_id, ref, alts): lineitem as records, a tenth each indels, multiallelic and long alternates.

    ``numbered`` adds rec_no, the record's place in a total order of the table: by stretches of order keys, which are counted
    first, so that no task numbers them all.
    """
    t = _table(spark, sf_dir, "lineitem")
    kind = F.col("l_quantity").cast("int")
    alt = F.concat(_base(F.col("l_orderkey") + 1 + kind % 3), F.when(kind % 10 == 1, ",G").when(kind % 10 == 2, "A").otherwise(""))
    columns = [
        F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("chrom"),
        (F.col("l_partkey") + 1).alias("pos"),
        F.col("l_orderkey").alias("rec_id"),
        F.concat(_base(F.col("l_orderkey")), F.when(kind % 10 == 0, "T").otherwise("")).alias("ref"),
        F.split(alt, ",").alias("alts"),
    ]
    if not numbered:
        return t.select(*columns)
    stretch = F.floor(F.col("l_orderkey") / NUMBERED).alias("stretch")
    ahead = F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))  # a row for each stretch
    offsets = t.groupBy(stretch).agg(F.count(F.lit(1)).alias("n")).select("stretch", F.coalesce(ahead, F.lit(0)).alias("offset"))
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    inside = F.row_number().over(Window.partitionBy("stretch").orderBy(*order))
    numbers = t.withColumn("stretch", F.floor(F.col("l_orderkey") / NUMBERED)).withColumn("inside", inside).join(offsets, "stretch")
    return numbers.select(*columns, (F.col("offset") + F.col("inside")).cast("long").alias("rec_no"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_idx, sample_id): the suppliers."""
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("sample_idx"), F.col("s_name").alias("sample_id"))


def region(spark: SparkSession, sf_dir: str) -> Region:
    """The whole of a contig."""
    return Region(CONTIG, 1, _table(spark, sf_dir, "part").agg(F.max("p_partkey")).head()[0] + 1)


def middle(whole: Region) -> Region:
    """The middle half of a contig."""
    return Region(whole.chrom, whole.end // 4 + 1, 3 * whole.end // 4)


def window(spark: SparkSession, sf_dir: str, wanted: Region | None = None) -> DataFrame:
    """(pos, base): part as the reference, with a fifth of N, or a region of it. The bounds stand on the bare key."""
    p = _table(spark, sf_dir, "part")
    if wanted is not None:
        p = p.where(F.col("p_partkey").between(wanted.start - 1, wanted.end - 1))
    return p.select((F.col("p_partkey") + 1).alias("pos"), F.substr(F.lit("ACGTN"), F.col("p_size") % 5 + 1, F.lit(1)).alias("base"))


def pieces(bases: DataFrame) -> DataFrame:
    """(start, sequence, length): (pos, base) in pieces of ``PIECE`` positions."""
    at = F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"])
    start = (F.floor((F.col("pos") - 1) / PIECE) * PIECE + 1).alias("start")
    return bases.groupBy(start).agg(F.array_join(at, "").alias("sequence"), F.count(F.lit(1)).alias("length"))


def with_genotypes(records: DataFrame, wanted: tuple[str, ...], n_samples: int, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``records`` with gts: a call for each of ``n_samples``. They depend on a remainder of the record, so there are only as many
    different lists as ``wanted`` has calls. ``made`` gives what is wanted of a table of lists, once for each list."""
    pick = F.array(*[F.lit(g) for g in wanted])
    call = lambda k: F.element_at(pick, ((F.col("remainder") + k * 13) % len(wanted)).cast("int") + 1)
    lists = records.sparkSession.range(len(wanted)).select(F.col("id").alias("remainder"))
    lists = lists.withColumn("gts", F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), call))
    lists = made(lists) if made else lists
    # In an aggregate, so that no filter of what is made, as explode gives one, is derived for the records by their remainder.
    lists = lists.groupBy("remainder").agg(*[F.first(c).alias(c) for c in lists.columns if c != "remainder"])
    small = len(wanted) * n_samples * 16 <= BROADCAST_BYTES
    return records.withColumn("remainder", F.col("rec_id") * 5 % len(wanted)).join(F.broadcast(lists) if small else lists, "remainder").drop("remainder")


def with_calls(records: DataFrame, wanted: tuple[str, ...], n_samples: int) -> DataFrame:
    """As :func:`with_genotypes`, for few samples: the lists stand in the plan, and no join takes the order of ``records`` away."""
    n = len(wanted)
    lists = F.array(*[F.array(*[F.lit(wanted[(r + k * 13) % n]) for k in range(n_samples)]) for r in range(n)])
    return records.withColumn("gts", F.get(lists, (F.col("rec_id") * 5 % n).cast("int")))


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; a temporary one where none is set on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="testbed")
    if "://" in shared.removeprefix("file://"):
        raise ValueError(f"files are written to a mounted folder, not to {shared}")
    shared = "/" + shared.removeprefix("file:").lstrip("/") if shared.startswith("file:") else shared
    return f"{shared.rstrip('/')}/testbed-{uuid.uuid4().hex}"


def header(whole: Region, ids: list[str]) -> list[str]:
    contigs = [f"##contig=<ID=chr{k},length={whole.end}>" for k in range(1, 8)]
    return ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="Passed">', *contigs, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *ids] if ids else [])])]


def in_file_order(spark: SparkSession, sf_dir: str, n_samples: int) -> DataFrame:
    """The records sorted by contig and position, as a file has them, with phased calls of ``n_samples``.

    Only what records are made of is shuffled, once: columns of lineitem are sorted, and records with their calls are made of
    them where they lie. Contig and position are one number, by which nearly all comparisons end; records that stand at one
    position are ordered by what is written of them.
    """
    place = F.substring("chrom", 4, 9).cast("long") * (1 << 56) + F.col("pos")
    return with_calls(variants(spark, sf_dir).orderBy(place, "rec_id", "ref", "alts"), PHASED, n_samples)


def save_files(spark: SparkSession, sf_dir: str, fmt: str, n_samples: int) -> tuple[str, str]:
    """All records as an indexed file, ``vcf.gz`` or ``bcf``, with phased calls of ``n_samples``, and the reference as FASTA with its index."""
    whole, at = region(spark, sf_dir), folder(spark)
    ids = [f"s{k}" for k in range(n_samples)]
    v = in_file_order(spark, sf_dir, n_samples).withColumn("line", F.lit(None).cast("string"))
    save = sinks.save_vcf if fmt == "vcf.gz" else sinks.save_bcf
    path = save(v, header(whole, ids), f"{at}/cohort.{fmt}", in_order=True)
    reference = f"{at}/reference.fa"
    bases = f"{at}/bases"  # the same for each contig
    with open(bases, "w") as f:
        f.writelines(row["sequence"] + "\n" for row in pieces(window(spark, sf_dir)).orderBy("start").toLocalIterator())
    place = 0
    with open(reference, "wb") as f, open(f"{reference}.fai", "w") as index, open(bases, "rb") as lines:
        for k in range(1, 8):
            place += f.write(f">chr{k}\n".encode())
            print(f"chr{k}", whole.end, place, PIECE, PIECE + 1, sep="\t", file=index)
            lines.seek(0)
            shutil.copyfileobj(lines, f)
            place += lines.tell()
    os.remove(bases)
    return path, reference
