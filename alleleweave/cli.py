"""Command line: ``python -m alleleweave.cli run ...`` and ``... inspect ...``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from alleleweave import api
from alleleweave.model import DTYPES, FORMATS, MODES

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def _switch(p: argparse.ArgumentParser, name: str, text: str) -> None:
    p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=True, help=text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="alleleweave", description="One-hot encoded personal sequences from variant files. Biallelic SNVs only.")
    commands = top.add_subparsers(dest="command", required=True, metavar="<command>")

    run = commands.add_parser("run", help="encode a region and write arrays")
    run.add_argument("-i", "--vcf", required=True, help="variant file: .vcf, .vcf.gz, .vcf.bgz or .bcf")
    run.add_argument("-s", "--samples", help="file of sample ids, one a line: which samples, in which order")
    run.add_argument("-r", "--region", required=True, help="chrom:start-end, 1-based and closed, with or without the prefix chr")
    run.add_argument("-f", "--fasta", required=True, help="reference FASTA")
    run.add_argument("-H", "--haplotype-mode", choices=MODES, default=MODES[0], help="one sequence for each sample, or two; two need phased calls")
    run.add_argument("-b", "--batch-size", type=int, help="samples in a file")
    run.add_argument("-m", "--max-memory-gb", type=float, help="memory budget that gives the batch size")
    _switch(run, "auto-batch-on-oom", "do it again in batches if memory runs out")
    _switch(run, "print-estimates", "log the result's size beforehand")
    run.add_argument("-o", "--out-dir", default=".", help="folder for the results")
    run.add_argument("-p", "--prefix", default="alleleweave", help="how the results' names begin")
    run.add_argument("-F", "--format", choices=FORMATS, default=FORMATS[0], help="hdf5 needs h5py, pt needs torch")
    run.add_argument("--per-sample", action="store_true", help="a file for each sample, and for each haplotype in separate mode")
    run.add_argument("-d", "--dtype", choices=tuple(DTYPES), default="float32", help="width of the numbers")
    run.set_defaults(use=_run)

    look = commands.add_parser("inspect", help="report on a variant file and filter it")
    look.add_argument("-i", "--vcf", required=True, help="variant file")
    look.add_argument("-r", "--region", help="chrom:start-end")
    look.add_argument("-n", "--n-check", type=int, default=2000, help="records to look at")
    look.add_argument("-t", "--threshold", type=float, default=0.01, help="share of other records above which a warning is logged")
    look.add_argument("-o", "--out-dir", help="folder for the filtered file; the input's by default")
    look.set_defaults(use=_inspect)

    for p in (run, look):
        p.add_argument("-l", "--log-level", choices=LEVELS, default="INFO")
    return top


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    api.run(
        spark, a.vcf, a.samples, a.region, a.fasta, a.haplotype_mode, a.batch_size, a.max_memory_gb, a.auto_batch_on_oom,
        a.print_estimates, a.out_dir, a.prefix, a.format, a.per_sample, a.dtype,
    )


def _inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    print(api.ensure_biallelic_snvs(spark, a.vcf, a.out_dir, a.n_check, a.threshold, a.region))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level, format="[%(levelname)s] %(message)s")
    args.use(spark or SparkSession.builder.appName("alleleweave").getOrCreate(), args)


if __name__ == "__main__":
    main()
