"""Six-column site metrics (bedGraph), validated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sam import numbered_lines


def whole(text: Column) -> Column:
    """A non-negative whole number, or null; a plain cast would also take blanks around it."""
    return F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("long"))


def metric_columns(path: str, line: Column) -> list[Column]:
    """chrom, start, end, methylated and unmethylated of a line of path; one that isn't six tab-separated fields with end = start + 1, a
    percentage of 100 at most and a depth above 0 is an error."""
    f = F.split(line, "\t")
    start, end, pct, m, u = (whole(F.get(f, F.lit(i))) for i in range(1, 6))
    ok = (F.size(f) == 6) & (f[0] != "") & (end == start + 1) & (pct <= 100) & (m + u > 0)
    bad = F.raise_error(F.concat(F.lit(f"{path}: not a metric: "), line)).cast("string")
    chrom = F.when(F.coalesce(ok, F.lit(False)), f[0]).otherwise(bad)
    return [chrom.alias("chrom"), start.alias("start"), end.alias("end"), m.alias("methylated"), u.alias("unmethylated")]


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """ord, block, chrom, start, end, methylated, unmethylated of each line. Empty lines and lines that begin with track are passed
    over; others that are no metrics are errors, as are starts that don't grow from line to line of a chromosome. Lines are held against the ones before them
    within each block of the file; check_chromosome_order() looks at the blocks' ends."""
    lines = numbered_lines(spark, path).where((F.col("value") != "") & ~F.col("value").startswith("track"))
    rows = lines.select("ord", "block", *metric_columns(path, F.col("value")))
    before = Window.partitionBy("block").orderBy("ord")
    order = F.raise_error(F.concat(F.lit(f"{path}: positions must grow: "), F.col("chrom"), F.lit(":"), F.col("start").cast("string"))).cast("long")
    falls = (F.lag("chrom").over(before) == F.col("chrom")) & (F.col("start") <= F.lag("start").over(before))
    return rows.withColumn("start", F.when(F.coalesce(falls, F.lit(False)), order).otherwise(F.col("start")))


def check_chromosome_order(metrics: DataFrame, path: str) -> None:
    """Raises if a chromosome comes again or if starts don't grow from one block of the file to the next. The driver gets a row for
    each chromosome and block."""
    ends = lambda f: f(F.struct("start", "ord"), "ord")["start"]
    parts = metrics.groupBy("block", "chrom").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), ends(F.min_by).alias("first"), ends(F.max_by).alias("last")).orderBy("lo").collect()
    seen: set[str] = set()
    for a, b in zip([None, *parts], parts):
        if a and b["lo"] < a["hi"] or b["chrom"] in seen and a["chrom"] != b["chrom"]:
            raise ValueError(f"{path}: chromosome {b['chrom'] if b['chrom'] in seen else a['chrom']} comes again")
        if a and a["chrom"] == b["chrom"] and b["first"] <= a["last"]:
            raise ValueError(f"{path}: positions must grow: {b['chrom']}:{b['first']}")
        seen.add(b["chrom"])
