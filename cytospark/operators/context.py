"""Cytosines of a reference with their contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import windows

CONTEXTS = ("CG", "CHG", "CHH")


#: Reference bases of a cell, in which pieces of reads meet the reference.
CELL = 1 << 10


def cells(chunks: DataFrame) -> DataFrame:
    """rid, cell, chrom, first and around of reference chunks (rid, chrom, start, seq, left, right): the upper-case bases, CELL at most,
    from the place first on, with two on either side, one byte each (N for all but A, C, G and T). Where chunks begin at
    multiples of CELL, as those of sources.fasta do, cell (first div CELL) names one row. No shuffle."""
    whole = F.upper(F.concat("left", "seq", "right"))
    # bytes, as a place in a string is found by walking there
    plain = F.when(whole.rlike("[^ACGTN]"), F.regexp_replace(whole, "[^ACGTN]", "N")).otherwise(whole).cast("binary")
    padded = chunks.select("rid", "chrom", "start", plain.alias("all"))
    # the generator looks at all, as Spark otherwise makes it anew for each row
    parts = padded.select("*", F.explode(F.expr(f"sequence(0, (length(all) - 5) div {CELL})")).alias("k")).withColumn("first", F.expr(f"start + k * {CELL}"))
    around = F.expr(f"substring(all, k * {CELL} + 1, {CELL} + 4)")
    return parts.select("rid", F.expr(f"first div {CELL}").alias("cell"), "chrom", "first", around.alias("around"))


def at_places(rows: DataFrame, place: str, keep: list[str]) -> DataFrame:
    """fwd, ctx and tri of the cytosines at a place (from 0) in around, with the columns of keep: fwd for a C, its reverse for a G.
    Rows with any other base there go. A neighbour that is missing or not a base counts as none, and as N in the
    trinucleotide."""
    is_base = lambda i, base: f"substring(around, cast({place} as int) + {i}, 1) = X'{ord(base):x}'"
    other = lambda i: "case " + " ".join(f"when {is_base(i, a)} then '{b}'" for a, b in ("GC", "CG", "AT", "TA")) + " else 'N' end"
    kind = lambda one, two, base: f"case when {is_base(one, base)} then 'CG' when {is_base(two, base)} then 'CHG' else 'CHH' end"
    # by bytes alone, as a filter of contexts is carried out before the columns are made
    own = rows.where(f"{is_base(3, 'C')} or {is_base(3, 'G')}").withColumn("fwd", F.expr(is_base(3, "C")))
    ctx = F.when(F.col("fwd"), F.expr(kind(4, 5, "G"))).otherwise(F.expr(kind(2, 1, "C")))
    after = F.expr(f"cast(substring(around, cast({place} as int) + 4, 2) as string)")
    tri = F.concat(F.lit("C"), F.when(F.col("fwd"), after).otherwise(F.concat(F.expr(other(2)), F.expr(other(1)))))
    return own.select(*keep, "fwd", ctx.alias("ctx"), tri.alias("tri"))


def cytosines(chunks: DataFrame) -> DataFrame:
    """rid, chrom, pos, fwd, ctx, tri of every C (forward) and G (reverse) of reference chunks. No shuffle."""
    places = cells(chunks).select("*", F.explode(F.expr("sequence(0, length(around) - 5)")).alias("k"))
    return at_places(places.withColumn("pos", F.col("first") + F.col("k")), "k", ["rid", "chrom", "pos"])


def kinds(chunks: DataFrame) -> DataFrame:
    """tri, ctx, fwd and n of the cytosines of reference chunks: batches count runs of five bases, so cytosines never become rows."""
    runs = cells(chunks).select("around").mapInArrow(windows, "around binary, n long").groupBy("around").agg(F.sum("n").alias("n"))
    return at_places(runs, "0", ["n"]).groupBy("tri", "ctx", "fwd").agg(F.sum("n").alias("n"))


def spans(sites: DataFrame) -> DataFrame:
    """sites (pos, fwd, ctx) with s and e: the reference span that a site and its counterpart on the other strand share; CHH sites
    stand alone."""
    width = F.when(F.col("ctx") == "CG", 2).when(F.col("ctx") == "CHG", 3).otherwise(1)
    start = F.when(F.col("fwd"), F.col("pos")).otherwise(F.col("pos") - width + 1)
    return sites.withColumn("s", start.cast("long")).withColumn("e", (start + width).cast("long"))
