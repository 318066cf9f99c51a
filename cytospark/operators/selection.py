"""Regions and intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import CELL

#: Places in a bin of the interval join, and cells with intervals of which the numbers are broadcast at most.
BIN, FEW_CELLS = 1 << 14, 1_000_000

Region = tuple[int, int, int]


def resolve_region(text: str, contigs: list[tuple[int, str, int]]) -> Region:
    """(rid, start, end), half open, of chr, chr:p or chr:a-b (1-based, inclusive). The end is clipped to the contig."""
    known = {n: (r, length) for r, n, length in contigs}
    m = re.fullmatch(r"(.+):([0-9,]+)(?:-([0-9,]+))?", text)
    name, a, b = (text, None, None) if text in known or not m else (m[1], int(m[2].replace(",", "")), m[3] and int(m[3].replace(",", "")))
    if name not in known:
        raise ValueError(f"unknown reference {name}")
    rid, length = known[name]
    start, end = (0, length) if a is None else (a - 1, min(a if b is None else b, length))
    if start < 0 or start >= end:
        raise ValueError(f"empty region {text}")
    return rid, start, end


def in_region(rows: DataFrame, region: Region | None, pos: str = "pos") -> DataFrame:
    """Rows whose place lies in the region; plain predicates, so that scans sorted by place can skip."""
    if region is None:
        return rows
    rid, start, end = region
    return rows.where((F.col("rid") == rid) & (F.col(pos) >= start) & (F.col(pos) < end))


def overlapping(reads: DataFrame, region: Region | None) -> DataFrame:
    """Aligned reads that reach into the region."""
    if region is None:
        return reads
    rid, start, end = region
    return reads.where((F.col("rid") == rid) & (F.col("start") < end) & (F.col("stop") > start))


def binned(bed: DataFrame) -> DataFrame:
    return bed.select(F.col("rid").alias("_rid"), F.col("top").alias("_top"), "s", "e", F.explode(F.sequence(F.floor(F.col("s") / BIN), F.floor((F.col("e") - 1) / BIN))).alias("_bin"))


def by_cells(bed: DataFrame) -> DataFrame:
    """rid, cell, on_top and on_bottom: the merged intervals that reach into each reference cell, by strand. A cell has half as many as
    places at most."""
    cell = F.explode(F.sequence(F.expr(f"s div {CELL}"), F.expr(f"(e - 1) div {CELL}")))
    rows = bed.select("rid", "top", F.struct("s", "e").alias("i"), cell.alias("cell"))
    on = lambda top: F.collect_list(F.when(F.col("top") == top, F.col("i")))
    return rows.groupBy("rid", "cell").agg(on(True).alias("on_top"), on(False).alias("on_bottom"))


def listed(beds: DataFrame) -> DataFrame:
    """The cells of by_cells(), broadcast if they are few, so that reads elsewhere go before they move."""
    keys = beds.select("rid", "cell")
    return F.broadcast(keys) if keys.count() <= FEW_CELLS else keys


def by_cell(top: str, pos: str) -> Column:
    """Whether a place lies in an interval of its strand, in rows with on_top and on_bottom."""
    has = lambda c: F.exists(c, lambda i: (F.col(pos) >= i["s"]) & (F.col(pos) < i["e"]))
    return F.coalesce(F.when(F.col(top), has("on_top")).when(~F.col(top), has("on_bottom")), F.lit(False))


def touching(reads: DataFrame, bed: DataFrame | None) -> DataFrame:
    """Aligned reads (ord, rid, top, start, stop) that overlap an interval of their strand. A read of no length touches nothing. Reads
    within one bin meet the intervals in a semi-join and go on from there; only those that lie in several bins are looked up
    by their parts first."""
    if bed is None:
        return reads
    first, last = F.floor(F.col("start") / BIN), F.floor(F.greatest(F.col("stop") - 1, F.col("start")) / BIN)
    on = (F.col("rid") == F.col("_rid")) & (F.col("top") == F.col("_top")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("stop"))
    inner = reads.where(first == last).join(binned(bed), on & (first == F.col("_bin")), "left_semi")
    several = reads.where(first != last)
    spread = several.select("ord", "rid", "top", "start", "stop", F.explode(F.sequence(first, last)).alias("_b"))
    hit = spread.join(binned(bed), on & (F.col("_b") == F.col("_bin")), "left_semi").select("ord")
    return inner.unionByName(several.join(hit, "ord", "left_semi"))
