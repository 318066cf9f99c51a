"""Qualities where the two reads of a pair cover the same place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjusted(bases: DataFrame, gaps: bool = False) -> DataFrame:
    """bases (rid, pos, name, ord, top, base, qual, eligible) with qual adjusted, so that a fragment counts once.

    At each place the eligible bases of one name pair up in order of ord: first with second, third with fourth. Of a pair on
    different strands both stay. With equal bases the higher quality (the later at a tie) gains a fifth, to 255 at most, and
    the other falls to 0. With different bases the higher one keeps the difference, unless it is N, and the other falls to
    0. Only eligible bases are shuffled by name; others pass by, and so do gaps (base null), if there are any. Whether a base
    is eligible is known of its read, so Spark tells the two sorts apart before reads become bases."""
    alone = bases.where(~F.col("eligible"))
    if gaps:
        alone = alone.unionByName(bases.where(F.col("eligible") & F.col("base").isNull()))
    place = Window.partitionBy("rid", "pos", "name").orderBy("ord")
    rows = bases.where(F.col("eligible") & F.col("base").isNotNull()).withColumn("_n", F.row_number().over(place))
    second = F.col("_n") % 2 == 0
    other = lambda c: F.when(second, F.lag(c).over(place)).otherwise(F.lead(c).over(place))
    rows = rows.select("*", *(other(c).alias(f"_{c}") for c in ("top", "base", "qual")))
    q, o = F.col("qual"), F.col("_qual")
    wins = (q > o) | ((q == o) & second)
    equal = F.when(wins, F.least(F.lit(255), q + F.floor(q / 5).cast("int"))).otherwise(0)
    unlike = F.when((q > o) & (F.col("base") != "N"), q - o).otherwise(0)
    changed = F.when(F.col("_base").isNull() | (F.col("top") != F.col("_top")), q).when(F.col("base") == F.col("_base"), equal).otherwise(unlike)
    return alone.unionByName(rows.withColumn("qual", changed).select(alone.columns))
