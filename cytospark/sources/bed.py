"""BED intervals, plain or gzip, as merged lists of top and bottom strand."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sam import numbered_lines

BED = "rid int, top boolean, s long, e long"
GZIP = b"\x1f\x8b"
Known = dict[str, tuple[int, int]]


def magic(spark: SparkSession, path: str) -> bytes:
    """The first two bytes of a file in any store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(b for b in (stream.read(), stream.read()) if b >= 0)
    finally:
        stream.close()


def intervals(line: str, known: Known, keep_strand: bool) -> list[tuple[int, bool, int, int]]:
    """Rows (rid, top, start, end) of a line, ends clipped to the contig; none of a comment or a track. A bad line is an error."""
    fields = line.split()
    if not fields or line.startswith("#") or fields[0] in ("track", "browser"):
        return []
    if len(fields) < 3:
        raise ValueError("a BED line needs three fields")
    if fields[0] not in known:
        raise ValueError(f"unknown reference {fields[0]}")
    if not all(re.fullmatch(r"\+?[0-9]+", x) for x in fields[1:3]):
        raise ValueError("coordinates must be whole numbers")
    rid, length = known[fields[0]]
    start, end = int(fields[1]), int(fields[2])
    if start >= end:
        raise ValueError("start must be before end")
    if start >= length:
        raise ValueError("start lies beyond the reference")
    strand = fields[5] if keep_strand and len(fields) > 5 else "."
    if strand not in ("+", "-", "."):
        raise ValueError(f"unknown strand {strand}")
    return [(rid, top, start, min(end, length)) for top in (True, False) if strand in (".", "+" if top else "-")]


def parse_bed(data: bytes, path: str, contigs: list[tuple[int, str, int]], keep_strand: bool = False) -> list[tuple[int, bool, int, int]]:
    """Rows of BED text, plain or gzip. Bad lines are errors with path and line."""
    known, out = {n: (r, length) for r, n, length in contigs}, []
    for number, line in enumerate((gzip.decompress(data) if data[:2] == GZIP else data).decode().splitlines(), 1):
        try:
            out += intervals(line, known, keep_strand)
        except ValueError as wrong:
            raise ValueError(f"{path}:{number}: {wrong}") from None
    return out


def bed_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord and value of the lines. A compressed file is told by its first bytes and read by one task, as it can't be split."""
    if path.endswith(".gz") or magic(spark, path) != GZIP:
        return numbered_lines(spark, path).select("ord", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                lines = gzip.decompress(data.as_py()).decode().splitlines()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["ord", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "ord long, value string")


def merged(bed: DataFrame) -> DataFrame:
    """Intervals that overlap or touch become one, by reference and strand."""
    order = Window.partitionBy("rid", "top").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = bed.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("k", island).groupBy("rid", "top", "k").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("k")


def read_bed(spark: SparkSession, path: str, contigs: DataFrame, keep_strand: bool = False) -> DataFrame:
    """The merged intervals of a file, whose lines tasks parse; the driver gets the header and, if there is one, the first bad line."""
    known = {r["chrom"]: (r["rid"], r["length"]) for r in contigs.select("rid", "chrom", "length").collect()}  # the header
    lines = bed_lines(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for number, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out += [(number, *row, None) for row in intervals(line, known, keep_strand)]
                except ValueError as wrong:
                    out.append((number, None, None, None, None, str(wrong)))
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names=["ord", "rid", "top", "s", "e", "wrong"])

    rows = lines.mapInArrow(run, f"ord long, {BED}, wrong string")
    if bad := rows.where("wrong is not null").orderBy("ord").first():
        raise ValueError(f"{path}:{lines.where(F.col('ord') <= bad['ord']).count()}: {bad['wrong']}")
    return merged(rows.where("wrong is null").select("rid", "top", "s", "e"))
