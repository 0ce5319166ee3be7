"""Genome coordinates: literals, binning, allele suffixes and natural order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_LITERAL = re.compile(r"\s*(?P<chrom>[^:\s]+?)\s*(?::\s*(?P<start>[\d,]+)\s*-\s*(?P<end>[\d,]+)\s*)?")


@dataclass(frozen=True)
class Region:
    """A chromosome, or the half-open stretch [start, end) of one."""

    chrom: str
    start: int | None = None
    end: int | None = None

    @property
    def whole(self) -> bool:
        return self.start is None

    def snapped(self, resolution: int) -> Region:
        """Start floored and end ceiled to multiples of the resolution."""
        if self.whole:
            return self
        return Region(self.chrom, self.start // resolution * resolution, -(-self.end // resolution) * resolution)


def parse_region(where: str | Region | list | tuple) -> Region:
    """"chr:start-end", "chr" or (chr, start, end); commas in numbers are ignored."""
    if isinstance(where, Region):
        return where
    if isinstance(where, (list, tuple)):
        if len(where) != 3:
            raise ValueError("a region needs chrom, start and end")
        return Region(str(where[0]), int(where[1]), int(where[2]))
    m = _LITERAL.fullmatch(where)
    if not m:
        raise ValueError(f"not a region: {where!r}")
    if m["start"] is None:
        return Region(m["chrom"])
    return Region(m["chrom"], int(m["start"].replace(",", "")), int(m["end"].replace(",", "")))


def region_columns(literal: Column) -> list[Column]:
    """chrom, start and end out of a column of literals; start and end are null for whole chromosomes."""
    number = lambda i: F.regexp_replace(F.regexp_extract(literal, r"^([^:]+):([\d,]+)-([\d,]+)$", i), ",", "")
    return [F.regexp_extract(literal, r"^([^:]+)", 1).alias("chrom"), F.nullif(number(2), F.lit("")).cast("bigint").alias("start"), F.nullif(number(3), F.lit("")).cast("bigint").alias("end")]


def in_region(region: Region, chrom: str = "chrom", pos: str = "pos", closed: bool = False) -> Column:
    """Positions of a region; ``closed`` includes its end."""
    there = F.col(chrom) == region.chrom
    if region.whole:
        return there
    upper = F.col(pos) <= region.end if closed else F.col(pos) < region.end
    return there & (F.col(pos) >= region.start) & upper


def bin_start(pos: Column | str, resolution: int) -> Column:
    """Start of the bin, floored for negative positions too."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    pos = pos.cast("bigint")
    return pos - F.pmod(pos, F.lit(resolution).cast("bigint"))


def midpoint_bin(start: Column | str, end: Column | str, resolution: int) -> Column:
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return bin_start(F.floor((start + end) / 2), resolution)


def with_allele_letter(chrom: Column | str) -> Column:
    """(pat) becomes a, (mat) becomes b."""
    chrom = F.col(chrom) if isinstance(chrom, str) else chrom
    return F.regexp_replace(F.regexp_replace(chrom, r"\(pat\)", "a"), r"\(mat\)", "b")


def without_haplotype(chrom: Column | str) -> Column:
    chrom = F.col(chrom) if isinstance(chrom, str) else chrom
    return F.regexp_replace(chrom, r"\((?:mat|pat)\)$", "")


def bare_chromosome(chrom: Column | str) -> Column:
    """The part chr and digits, X or Y; null without one."""
    chrom = F.col(chrom) if isinstance(chrom, str) else chrom
    return F.nullif(F.regexp_extract(chrom, r"(chr[\dXY]+)", 1), F.lit(""))


def natural_order(chrom: Column | str) -> Column:
    """A sort key: letters first by text, embedded number by value, then the rest."""
    chrom = F.col(chrom) if isinstance(chrom, str) else chrom
    number = F.nullif(F.regexp_extract(chrom, r"(\d+)", 1), F.lit("")).cast("bigint")
    return F.struct(number.isNull(), number, F.regexp_extract(chrom, r"^(\D*)", 1), chrom)


def karyotype_order(chrom: Column | str) -> Column:
    """A sort key by allele (a before b), then number with X as 100 and Y as 101."""
    chrom = F.col(chrom) if isinstance(chrom, str) else chrom
    name = F.regexp_extract(chrom, r"^chr(\d+|X|Y)", 1)
    number = F.when(name == "X", 100).when(name == "Y", 101).otherwise(F.nullif(name, F.lit("")).try_cast("int"))
    return F.struct(F.regexp_extract(chrom, r"([ab])$", 1), number, chrom)


def human_position(pos: Column | str) -> Column:
    """1500000 as 1.5M, 20000 as 20k."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    short = lambda x, unit: F.concat(F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", ""), F.lit(unit))
    return F.when(pos >= 1_000_000, short(pos / 1_000_000, "M")).when(pos >= 1000, short(pos / 1000, "k")).otherwise(pos.cast("string"))


def resolution_name(resolution: int) -> str:
    """20000 as 20k, 1000000 as 1m."""
    for size, unit in ((1_000_000, "m"), (1000, "k")):
        if resolution >= size and resolution % size == 0:
            return f"{resolution // size}{unit}"
    return str(resolution)


def sample_name(path: Column | str) -> Column:
    """File name up to its first dot."""
    path = F.col(path) if isinstance(path, str) else path
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)
