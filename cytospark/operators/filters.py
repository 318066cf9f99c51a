"""Filters of whole reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reads import DUPLICATE, UNMAPPED, masked


@dataclass(frozen=True)
class ReadFilter:
    minimum_mapping_quality: int = 10
    ignore_flags: int = 0xF00
    require_flags: int = 0
    keep_duplicates: bool = False
    keep_singletons: bool = False
    keep_discordant: bool = False
    ignore_nh: bool = False
    #: Whether duplicates, singletons and discordant pairs are left to the flags.
    flags_only: bool = False

    @classmethod
    def per_read(cls, **options) -> ReadFilter:
        """Only mapping, quality, flags and NH."""
        return cls(**({"ignore_flags": 0, "flags_only": True} | options))

    def passes(self) -> Column:
        flag = F.col("flag")
        ignored = self.ignore_flags & ~DUPLICATE if self.keep_duplicates else self.ignore_flags
        ok = masked(flag, UNMAPPED, 0) & (F.col("mapq") >= self.minimum_mapping_quality) & masked(flag, ignored, 0) & masked(flag, self.require_flags)
        if not self.keep_duplicates and not self.flags_only:
            ok &= masked(flag, DUPLICATE, 0)
        if not self.keep_singletons and not self.flags_only:
            ok &= ~masked(flag, 9)
        if not self.keep_discordant and not self.flags_only:
            ok &= ~masked(flag, 3, 1)
        if not self.ignore_nh:
            ok &= number_of_hits(F.col("nh")) <= 1
        return ok


def number_of_hits(nh: Column) -> Column:
    """The number in an NH tag (i:number); 0 if there is none, an error if it is no whole number or negative."""
    n = F.when(nh.rlike("^i:[0-9]+$"), F.substring(nh, 3, 20).cast("long"))
    return F.when(nh.isNull(), F.lit(0).cast("long")).when(n.isNotNull(), n).otherwise(F.raise_error(F.concat(F.lit("NH must be a non-negative whole number, not "), nh)).cast("long"))


def converted_enough(reads: DataFrame, calls: DataFrame, minimum: float) -> DataFrame:
    """The reads of whose calls outside CpG at least the share minimum is unmethylated, or that have none. calls (ord, ctx,
    meth) are all of the reads', untrimmed. With a minimum of 0 the reads are returned as they are."""
    if not 0 <= minimum <= 1:
        raise ValueError("the minimum conversion efficiency must lie within 0 and 1")
    if minimum == 0:
        return reads
    low = calls.where("ctx <> 'CG'").groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("meth")).alias("u")).where(F.col("u") / F.col("n") < minimum)
    return reads.join(low.select("ord"), "ord", "left_anti")
