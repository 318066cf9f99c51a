"""How much of a reference reads cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import Region, overlapping

#: Reference places of a bin in which the union of reads is measured.
BIN = 1 << 14


def examined_columns(reads: DataFrame, region: Region | None = None) -> DataFrame:
    """rid and n, the places within the region that aligned reads (rid, start, stop) cover, deleted and skipped ones among them, each
    counted once. Reads are cut at bins, and of those that begin at one place in a bin the longest stands for all, so a bin has
    a row for each of its places at most, however deep it is. Within a bin, what goes beyond the furthest end so far counts."""
    rows = overlapping(reads, region).select("rid", "start", "stop")
    if region:
        rows = rows.select("rid", F.greatest("start", F.lit(region[1])).alias("start"), F.least("stop", F.lit(region[2])).alias("stop"))
    rows = rows.where("stop > start").select("*", F.explode(F.expr(f"sequence(start div {BIN}, (stop - 1) div {BIN})")).alias("bin"))
    cut = rows.select("rid", "bin", F.expr(f"greatest(start, bin * {BIN})").alias("s"), F.expr(f"least(stop, (bin + 1) * {BIN})").alias("e"))
    longest = cut.groupBy("rid", "bin", "s").agg(F.max("e").alias("e"))
    before = F.max("e").over(Window.partitionBy("rid", "bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    new = longest.select("rid", F.greatest(F.col("e") - F.greatest("s", F.coalesce(before, "s")), F.lit(0)).alias("new"))
    return new.groupBy("rid").agg(F.sum("new").alias("n"))
