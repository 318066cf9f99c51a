"""Reads as bases on the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reads import bisulfite_strand, cigar_walk, is_top, masked, methylated, read_number, within_bounds
from .context import CELL, at_places, cells
from .selection import by_cell, listed

Bounds = dict[str, tuple[int, int, int, int]]
#: Reference bases of a piece of a read at most; divides CELL.
PIECE = 1 << 8


def aligned(reads: DataFrame) -> DataFrame:
    """reads with strand (null if undetermined), top, read, walk (see cigar_walk) and stop, the end on the reference. A CIGAR that
    is malformed or doesn't use up the bases is an error."""
    n = F.when(F.col("bases") == "*", 0).otherwise(F.length("bases"))
    # filters of lines that are no reads may come later, and such lines have no name
    wrong = F.when(F.col("name").isNotNull(), F.raise_error(F.concat(F.lit("invalid CIGAR of read "), F.col("name"))))
    rows = reads.withColumn("walk", cigar_walk(F.col("cigar"), F.col("start"))).withColumn("strand", bisulfite_strand(F.col("flag"), F.col("xg")))
    rows = rows.withColumn("walk", F.when(F.coalesce(F.col("walk.qlen") == n, F.lit(False)), F.col("walk")).otherwise(wrong))
    return rows.select("*", is_top(F.col("strand")).alias("top"), read_number(F.col("flag")).alias("read"), F.col("walk.stop").alias("stop"))


def strict(rows: DataFrame) -> DataFrame:
    """rows in which a strand that can't be told is an error."""
    wrong = F.when(F.col("name").isNotNull(), F.raise_error(F.concat(F.lit("cannot determine the bisulfite strand of read "), F.col("name"))).cast("string"))
    return rows.withColumn("strand", F.coalesce("strand", wrong))


def pieces(reads: DataFrame, keep: list[str | Column], gaps: bool = False) -> DataFrame:
    """One row for each part of an aligned block of aligned() reads that lies in one grid cell of PIECE reference bases: the
    columns of keep, rid, q and r (its first place in the read and on the reference), n, b and s (its bases and qualities, null
    without); places beyond the read's qualities go. gaps adds the parts of deleted and skipped reference, with q and b null. So what is looked up for a base is
    never longer than a piece."""
    # how far bases and qualities reach, once for each read; cuts are made in the last step alone
    held = F.least(F.length("bases"), F.when(F.col("quals") != "*", F.length("quals"))).alias("_held")
    own, blocks = ([F.expr("size(walk.blocks)").alias("_own")], "concat(walk.blocks, walk.gaps)") if gaps else ([], "walk.blocks")
    rows = reads.select(*keep, "bases", "quals", held, *own, F.posexplode(F.expr(blocks)).alias("_i", "x")).where("x.n > 0")
    names = [c for c in rows.columns if c not in ("bases", "quals", "_held", "_own", "_i", "x")]
    rows = rows.withColumn("gap", F.expr("_i >= _own") if gaps else F.lit(False))
    rows = rows.select("*", F.explode(F.expr(f"sequence(x.r div {PIECE}, (x.r + x.n - 1) div {PIECE})")).alias("k")).withColumn("r", F.expr(f"greatest(x.r, k * {PIECE})"))
    rows = rows.withColumn("q", F.expr("if(gap, null, x.q + r - x.r)")).withColumn("n", F.expr(f"cast(least(x.r + x.n - r, (k + 1) * {PIECE} - r, _held - q) as int)"))
    cut = lambda c: f"substring({c}, cast(q as int) + 1, n)"
    return rows.where("n > 0").select(*names, "q", "r", "n", F.expr(f"if(gap, null, {cut('bases')})").alias("b"), F.expr(f"if(gap or quals = '*', null, {cut('quals')})").alias("s"))


def _bases(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of pieces for each of their places k, with qpos, pos, base and qual (255 without qualities, 0 in gaps)."""
    base = F.expr("substring(b, k + 1, 1)").alias("base")
    qual = F.expr("if(b is null, 0, if(s is null, 255, ascii(substring(s, k + 1, 1)) - 33))").alias("qual")
    return rows.select(*keep, F.expr("q + k").alias("qpos"), F.expr("r + k").alias("pos"), base, qual)


def exploded(reads: DataFrame, keep: list[str | Column]) -> DataFrame:
    """One row for each aligned base of aligned() reads: the columns of keep, qpos, pos, base and qual."""
    rows = pieces(reads, keep)
    names = rows.columns[:-5]
    return _bases(rows.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("k")), names)


def at_cytosines(reads: DataFrame, chunks: DataFrame, keep: list[str | Column], contexts: tuple[str, ...], informative: bool = False, beds: DataFrame | None = None) -> DataFrame:
    """One row for each aligned base of aligned() reads at a cytosine of the contexts: the columns of keep (rid among them),
    chrom, fwd, ctx, tri, qpos, pos, base and qual. Pieces of reads meet the reference's cells in an equi-join, so that bases
    elsewhere never become rows that move. informative leaves out bases that tell nothing of methylation on the read's strand
    (top). Of beds, intervals by cell (selection.by_cells()), bases outside of those of their read's strand are left out, in
    cells without intervals before they move."""
    rows = pieces(reads, keep)
    names, own, keys = rows.columns[:-5], cells(chunks).drop("first"), ["rid", "cell"]
    rows = rows.withColumn("cell", F.expr(f"r div {CELL}"))
    lists = []
    if beds is not None:
        rows, own, lists = rows.join(listed(beds), keys, "left_semi"), own.join(beds, keys), ["on_top", "on_bottom"]
    found = rows.join(own, keys)
    found = found.withColumn("around", F.expr(f"substring(around, cast(r - cell * {CELL} as int) + 1, n + 4)"))
    found = found.where("length(around) > 4")  # a read may reach beyond the reference
    found = found.select("*", F.explode(F.expr("sequence(0, least(n, length(around) - 4) - 1)")).alias("k"))
    found = at_places(found, "k", [*names, *lists, "chrom", "q", "r", "k", "b", "s"]).where(F.col("ctx").isin(*contexts))
    out = _bases(found, [*names, *lists, "chrom", "fwd", "ctx", "tri"])
    out = out.where(by_cell("top", "pos")).drop(*lists) if lists else out
    return out.where("fwd = top and if(top, base in ('C', 'T'), base in ('G', 'A'))") if informative else out


def trimmed(bases: DataFrame, inclusion: Bounds, fixed: Bounds) -> DataFrame:
    """bases (strand, read, qpos, length) within the bounds; gaps, without qpos, stay."""
    keep = within_bounds(F.col("strand"), F.col("read"), F.col("qpos"), F.col("length"), inclusion, fixed)
    return bases if keep is None else bases.where(F.col("qpos").isNull() | F.coalesce(keep, F.lit(True)))


def calls(bases: DataFrame, minimum_quality: int) -> DataFrame:
    """Methylation calls: informative bases at cytosines (top, base, qual) of the quality, with meth."""
    if minimum_quality < 1:
        raise ValueError("the minimum base quality must be positive")
    return bases.withColumn("meth", methylated(F.col("top"), F.col("base"))).where(F.col("qual") >= minimum_quality)


def may_overlap(flag=None):
    """Paired, with a mapped mate."""
    flag = F.col("flag") if flag is None else flag
    return masked(flag, 1) & masked(flag, 8, 0)
