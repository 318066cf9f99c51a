"""Merging of site metrics that arrive in order, with a state that holds what isn't settled yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import analyses
from ..sources.bedgraph import metric_columns

#: The line that says that nothing comes after it.
END = "#end"
#: Places by which a span may begin before a site that has already been seen.
BEHIND = 3


def stream_metrics(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the lines of a growing folder of site metrics, whose files must come in the order of their places."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def stream_merge(lines: DataFrame, reference: DataFrame, contigs: list[tuple[int, str, int]]) -> DataFrame:
    """chrom, s, e, m, u and n of each CpG and CHG span (CHH sites alone), for output mode append: a span goes out once, when the
    stream has passed it, and its state is dropped then. contigs are those of the stream, in its order.

    Places along all contigs count as the stream's time, so the watermark is the furthest place so far; sites of a span lie
    within BEHIND places of one another. A line END settles what is left. Reference chunks are a static side."""
    at, begins = 0, []
    for _, name, length in contigs:
        begins.append((name, at))
        at += length + 2 * BEHIND
    known = F.broadcast(lines.sparkSession.createDataFrame(begins, "chrom string, begin long"))  # the header
    own = lines.where((F.col("value") != "") & ~F.col("value").startswith("track") & (F.col("value") != END))
    sites = analyses.site_spans(own.select(*metric_columns("a stream", F.col("value"))), reference).join(known, "chrom")
    placed = sites.select("chrom", "s", "e", "methylated", "unmethylated", F.timestamp_seconds(F.col("begin") + F.col("s")).alias("at"))
    none = lambda kind: F.lit(None).cast(kind)
    last = lines.where(F.col("value") == END).select(none("string"), none("long"), none("long"), none("long"), none("long"), F.timestamp_seconds(F.lit(at + 4 * BEHIND)))
    rows = placed.union(last).withWatermark("at", f"{BEHIND} seconds")
    sums = rows.groupBy("at", "chrom", "s", "e").agg(F.sum("methylated").alias("m"), F.sum("unmethylated").alias("u"), F.count("chrom").alias("n"))
    return sums.where("n > 0").drop("at")  # a filter of keys would go before the watermark
