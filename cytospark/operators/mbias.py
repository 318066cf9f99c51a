"""Methylation by place in the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reads import STRANDS
from ..functions.stats import agresti_coull


def histogram(calls: DataFrame) -> DataFrame:
    """strand, read, position (1-based), m, u of calls (strand, read, qpos, meth): added up in tasks before the shuffle."""
    return calls.groupBy("strand", "read", (F.col("qpos") + 1).alias("position")).agg(F.count_if("meth").alias("m"), F.count_if(~F.col("meth")).alias("u"))


def with_intervals(rows: DataFrame) -> DataFrame:
    """The histogram with fraction, lower and upper."""
    lower, upper = agresti_coull(F.col("m"), F.col("u"))
    return rows.select("*", (F.col("m") / (F.col("m") + F.col("u"))).alias("fraction"), lower.alias("lower"), upper.alias("upper"))


def suggestions(rows: DataFrame) -> DataFrame:
    """strand and bounds (read 1 left and right, read 2 left and right) from a histogram; 0 is no bound.

    Places from two to eight tenths of the strand's longest read calibrate: their mean fraction and the extremes of their
    intervals. An outlier's interval lies wholly on one side of the mean, its fraction beyond those extremes and more than 0.05
    from the mean. The outliers nearest to the middle on either side bound the part to keep. Strands without calls give no
    row."""
    every = with_intervals(rows).withColumn("length", F.max("position").over(Window.partitionBy("strand"))).withColumn("i", F.col("position") - 1)
    tenth = lambda k: F.floor(F.col("length") * k / 10)
    cal = (F.col("i") >= tenth(2)) & (F.col("i") <= tenth(8))
    whole = Window.partitionBy("strand", "read")
    over = lambda f, c: f(F.when(cal, F.col(c))).over(whole)
    seen = every.select("*", over(F.avg, "fraction").alias("mean"), F.least(over(F.min, "lower"), F.lit(1.0)).alias("least"), F.greatest(over(F.max, "upper"), F.lit(0.0)).alias("most"))
    apart = ((F.col("upper") < F.col("mean")) & (F.col("fraction") < F.col("least"))) | ((F.col("lower") > F.col("mean")) & (F.col("fraction") > F.col("most")))
    out, middle = apart & (F.abs(F.col("fraction") - F.col("mean")) > 0.05), F.floor(F.col("length") / 2)
    left = F.max(F.when(out & (F.col("i") <= middle), F.col("i") + 2))
    right = F.min(F.when(out & (F.col("i") > middle), F.col("i")))
    ends = seen.groupBy("strand", "read").agg(F.coalesce(left, F.lit(0)).cast("long").alias("left"), F.coalesce(right, F.lit(0)).cast("long").alias("right"))
    of = lambda n, c: F.coalesce(F.max(F.when(F.col("read") == n, F.col(c))), F.lit(0))
    return ends.groupBy("strand").agg(F.array(of(1, "left"), of(1, "right"), of(2, "left"), of(2, "right")).alias("bounds"))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.array_position(F.array(*map(F.lit, STRANDS)), F.col("strand")), "position", "read")
