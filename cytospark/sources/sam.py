"""SAM text as a DataFrame of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READS = "ord long, name string, flag int, rid int, chrom string, start long, mapq int, cigar string, bases string, quals string, xg string, nh string"
CONTIGS = "rid int, chrom string, length long"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one file as value, ord, which grows along the file, and block, the offset of the file's block. A line's place in
    its block is less than the block's bytes, so the block's offset plus that place orders all lines without a shuffle."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"))
    return lines.select("value", (F.col("block") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("ord"), "block")


def header(lines: DataFrame) -> list[tuple[int, str, int]]:
    """rid, name and length of each @SQ line in order; the driver gets the header lines only."""
    rows = lines.where(F.col("value").startswith("@SQ\t")).orderBy("ord").select("value").collect()
    out = []
    for i, row in enumerate(rows):
        fields = dict(x.split(":", 1) for x in row["value"].split("\t")[1:] if ":" in x)
        out.append((i, fields["SN"], int(fields["LN"])))
    return out


def tag(line: Column, name: str) -> Column:
    """The text of a tag of any type, with its type before it; null if absent."""
    return F.nullif(F.regexp_extract(line, rf"\t{name}:([AifZHB]:[^\t]*)", 1), F.lit(""))


def parsed(lines: DataFrame, contigs: list[tuple[int, str, int]]) -> DataFrame:
    """Reads of alignment lines; a contig that the header lacks is an error. Works on streams, too, if lines has ord."""
    spark = lines.sparkSession
    record = ~F.col("value").startswith("@") & (F.col("value") != "")
    # filters may be evaluated in any order, so header lines have no fields that could fail to be numbers
    rows = lines.where(record).withColumn("f", F.when(record, F.split("value", "\t")))
    f = lambda i: F.get("f", F.lit(i))
    xg, nh = tag(F.col("value"), "XG"), tag(F.col("value"), "NH")
    reads = rows.select("ord", f(0).alias("name"), f(1).cast("int").alias("flag"), f(2).alias("chrom"), (f(3).cast("long") - 1).alias("start"), f(4).cast("int").alias("mapq"), f(5).alias("cigar"), F.upper(f(9)).alias("bases"), f(10).alias("quals"), F.substring(xg, 3, 1000).alias("xg"), nh.alias("nh"))
    known = F.broadcast(spark.createDataFrame([(r, c) for r, c, _ in contigs], "rid int, chrom string"))  # the header
    found = reads.join(known, "chrom", "left")
    missing = F.raise_error(F.concat(F.lit("reference not in the header: "), F.col("chrom"))).cast("int")
    return found.select("ord", "name", "flag", F.when(F.col("chrom") == "*", -1).when(F.col("rid").isNull(), missing).otherwise(F.col("rid")).alias("rid"), "chrom", "start", "mapq", "cigar", "bases", "quals", "xg", "nh")


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """reads and contigs of a SAM file."""
    lines = numbered_lines(spark, path)
    contigs = header(lines)
    return parsed(lines, contigs), spark.createDataFrame(contigs, CONTIGS)
