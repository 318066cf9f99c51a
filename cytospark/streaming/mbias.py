"""The M-bias histogram of a growing folder of SAM files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import analyses
from ..plans.options import PileupOptions
from ..sources.sam import parsed


def stream_sam(spark: SparkSession, folder: str, contigs: list[tuple[int, str, int]], files_per_trigger: int = 16) -> DataFrame:
    """A stream of reads; every file must have the contigs of the header given. ord is 0, as files have no order among them."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parsed(lines.select("value", F.lit(0).cast("long").alias("ord")), contigs)


def stream_mbias(reads: DataFrame, reference: DataFrame, options: PileupOptions = PileupOptions()) -> DataFrame:
    """The histogram of all reads so far, for output mode complete or update. Its state is one row for each strand, read and
    place in a read, however long the stream runs; reference chunks are a static side,
    read from a stored table (numbering the lines of a FASTA file isn't allowed within a stream). The conversion filter needs a read's calls
    together and isn't offered."""
    if options.minimum_conversion_efficiency:
        raise ValueError("the conversion filter isn't available on streams")
    return analyses.mbias(reads, reference, options)
