"""Indexed FASTA references: bases by place, without reading the rest of the file.

The index (.fai) has for each contig its length, the offset of its first base and the geometry of its lines, so that a place
is an offset. Chunks that are wanted become byte ranges; tasks read these and nothing else. Names and lengths are checked from
the index alone. The reference must be a plain file that every executor can read under its path; without an index,
sources.fasta reads the whole of it.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fasta

INDEX = "chrom string, length long, offset long, line_bases long, line_width long"
CHUNKS = "rid int, chrom string, start long, seq string, left string, right string"
#: Chunks that lie side by side go to one task, so many at a time.
TOGETHER = 64


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def indexed(path: str) -> bool:
    """Whether there is an index beside the reference; a compressed one can't be read by place."""
    return not path.endswith((".gz", ".bgz")) and os.path.exists(f"{local(path)}.fai")


def read_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """name, length, offset, bases and bytes of a line of each contig of the reference. A line that isn't that, and a name that occurs
    twice, are errors."""
    at, out = f"{local(path)}.fai", []
    with open(at, encoding="utf-8") as f:
        for number, line in enumerate(f, 1):
            fields = line.rstrip("\r\n").split("\t")
            if len(fields) != 5 or not fields[0] or not all(x.isascii() and x.isdigit() for x in fields[1:]):
                raise ValueError(f"{at}:{number}: not a line of an index")
            length, offset, bases, width = map(int, fields[1:])
            if length and not 0 < bases <= width:
                raise ValueError(f"{at}:{number}: lines of {bases} bases in {width} bytes")
            out.append((fields[0], length, offset, bases, width))
    if twice := sorted(n for n, k in Counter(x[0] for x in out).items() if k > 1):
        raise ValueError(f"{path}: duplicate reference {twice[0]}")
    return out


def check_index(index: list[tuple[str, int, int, int, int]], contigs: list[tuple[int, str, int]]) -> None:
    """Raises if a contig (rid, chrom, length) isn't in the index or has another length there."""
    known = {x[0]: x[1] for x in index}
    for _, name, length in contigs:
        if known.get(name) != length:
            raise ValueError(f"reference {name}: " + ("missing" if name not in known else f"length {known[name]}, {length} in the alignment"))


def byte_range(start: int, end: int, offset: int, bases: int, width: int) -> tuple[int, int]:
    """Where the bases from start to end lie in the file."""
    place = lambda at: offset + at // bases * width + at % bases
    return place(start), place(end - 1) + 1


def touched(reads: DataFrame) -> DataFrame:
    """rid and k of the chunks that aligned reads (rid, start, stop) lie in: tasks leave one row for each of theirs."""
    k = F.explode(F.sequence(F.floor(F.col("start") / fasta.CHUNK), F.floor((F.greatest("stop", F.col("start") + 1) - 1) / fasta.CHUNK)))
    return reads.select("rid", k.alias("k")).distinct()


def within(rid: int, start: int, end: int, spark: SparkSession) -> DataFrame:
    """rid and k of the chunks of a range."""
    return spark.range(start // fasta.CHUNK, (end - 1) // fasta.CHUNK + 1).select(F.lit(rid).alias("rid"), F.col("id").alias("k"))


def indexed_chunks(spark: SparkSession, path: str, contigs: list[tuple[int, str, int]], wanted: DataFrame | None = None) -> DataFrame:
    """Reference chunks as of fasta.reference_chunks(), of contigs (rid, chrom, length) that have been checked: those of wanted (rid,
    k, in any number), or all. Each task opens the file and reads the ranges of its chunks, with the two bases on either side."""
    path, known = local(path), {x[0]: x for x in read_index(path)}
    rows = [(rid, *known[name]) for rid, name, _ in contigs]
    own = spark.createDataFrame(rows, f"rid int, {INDEX}").where("length > 0")  # the header
    size = fasta.CHUNK
    every = own.select("*", F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")).alias("k")) if wanted is None else F.broadcast(own).join(wanted.select("rid", "k").distinct(), "rid").where(f"k * {size} < length")
    dealt = every.withColumn("_set", F.floor(F.col("k") / TOGETHER)).repartition("rid", "_set").sortWithinPartitions("rid", "k").drop("_set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    start, length = row["k"] * size, row["length"]
                    end = min(start + size, length)
                    first, last = max(start - 2, 0), min(end + 2, length)
                    begin, stop = byte_range(first, last, row["offset"], row["line_bases"], row["line_width"])
                    f.seek(begin)
                    bases = b"".join(f.read(stop - begin).split()).decode("ascii", "replace").upper()
                    if len(bases) != last - first or ">" in bases:
                        raise ValueError(f"{path}: the index doesn't fit the file at {row['chrom']}:{first}")
                    bases = "N" * (2 - (start - first)) + bases + "N" * (2 - (last - end))
                    out.append((row["rid"], row["chrom"], start, bases[2:-2], bases[:2], bases[-2:]))
                rid, chrom, start, *text = zip(*out) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int32()), pa.array(chrom, pa.string()), pa.array(start, pa.int64()), *(pa.array(c, pa.string()) for c in text)], names=["rid", "chrom", "start", "seq", "left", "right"])

    return dealt.mapInArrow(run, CHUNKS)
