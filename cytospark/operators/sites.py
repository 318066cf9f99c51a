"""Counts by cytosine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .context import spans

SITE = ("rid", "chrom", "pos", "fwd", "ctx", "tri")


def judged(counts: DataFrame, minimum_opposite_depth: int = 0, maximum_variant_fraction: float = 0.0) -> DataFrame:
    """The cytosines of pileup() with m, u, opposite and variant counts and excluded: whether more than the fraction of the other
    strand's bases, at that depth or more, show a variant. A base of undetermined strand at a cytosine is an error."""
    if not 0 <= maximum_variant_fraction <= 1:
        raise ValueError("the maximum variant fraction must lie within 0 and 1")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    odd = F.when(zero("odd") > 0, F.raise_error(F.lit("cannot determine a bisulfite strand")).cast("long")).otherwise(zero("m"))
    rows = counts.select(*SITE, odd.alias("m"), *(zero(c).alias(c) for c in ("u", "opposite", "variant")))
    if not minimum_opposite_depth:
        return rows.withColumn("excluded", F.lit(False))
    varied = F.col("variant") / F.nullif("opposite", F.lit(0)) > maximum_variant_fraction
    return rows.withColumn("excluded", (F.col("opposite") >= minimum_opposite_depth) & F.coalesce(varied, F.lit(False)))


def merged_sites(sites: DataFrame, minimum_depth: int = 1) -> DataFrame:
    """rid, chrom, s, e, ctx, m, u, n: the sums over the sites (at depth 1 or more, or excluded) of each CpG and CHG span; CHH sites
    as they are. A span with an excluded site goes; then the depth counts. n is the number of sites in it."""
    rows = spans(sites.where("excluded or m + u >= 1"))
    sums = rows.groupBy("rid", "chrom", "ctx", "s", "e", F.when(F.col("ctx") == "CHH", F.col("fwd")).alias("_own")).agg(F.sum("m").alias("m"), F.sum("u").alias("u"), F.bool_or("excluded").alias("excluded"), F.count(F.lit(1)).alias("n"))
    return sums.where(~F.col("excluded") & (F.col("m") + F.col("u") >= minimum_depth)).select("rid", "chrom", "s", "e", "ctx", "m", "u", "n")
