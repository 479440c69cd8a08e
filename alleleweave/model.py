"""Regions, schemas and the names of modes and formats."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("average", "separate")
FORMATS = ("npy", "npz", "hdf5", "pt")
DTYPES = {"float32": 4, "float16": 2}
CHANNELS = "ACGT"

VARIANTS = "rec_no long, chrom string, pos long, ref string, alts array<string>, gts array<string>, n_fields int, line string"
SAMPLES = "sample_idx int, sample_id string"


def one_of(value: str, known, what: str) -> str:
    if value not in known:
        raise ValueError(f"{what} {value!r} is none of {', '.join(known)}")
    return value


@dataclass(frozen=True)
class Region:
    """A closed interval of 1-based positions on a contig."""

    chrom: str
    start: int
    end: int

    @classmethod
    def parse(cls, text: str | None) -> Region:
        """``chrom:start-end``; thousands may be set off by commas, and a contig's name may hold colons."""
        if not text:
            raise ValueError("a region is needed: chrom:start-end")
        chrom, colon, span = text.strip().rpartition(":")
        first, dash, last = span.replace(",", "").partition("-")
        if not (colon and dash and chrom):
            raise ValueError(f"not a region: {text!r}; expected chrom:start-end")
        region = cls(chrom.strip(), int(first), int(last))
        if region.start < 1 or region.end < region.start:
            raise ValueError(f"not a region: {text!r}; positions count from 1 and the end isn't before the start")
        return region

    def __len__(self) -> int:
        return self.end - self.start + 1

    def __str__(self) -> str:
        return f"{self.chrom}:{self.start}-{self.end}"

    def on(self, chrom: str) -> Region:
        return Region(chrom, self.start, self.end)

    @property
    def file_part(self) -> str:
        return str(self).replace(":", "_").replace("-", "_")
