"""FASTA references as chunks, with two bases of each neighbour."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sam import numbered_lines

#: Reference bases of a chunk; a multiple of the cells in which reads meet the reference.
CHUNK = 1 << 14


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, seq (as in the file): the lines of a FASTA file with their places. A name that occurs twice is an error.
    Lengths add up within each block of the file; the driver gets a row for each header and each block, and sends back where
    each of them begins."""
    lines = numbered_lines(spark, path).withColumn("head", F.col("value").startswith(">")).withColumn("seq", F.when(F.col("head"), "").otherwise(F.regexp_replace("value", r"\s", "")))
    within = Window.partitionBy("block").orderBy("ord")
    lines = lines.withColumn("nth", F.sum(F.col("head").cast("int")).over(within)).withColumn("n", F.length("seq").cast("long"))
    parts = lines.groupBy("block", "nth").agg(F.sum("n").alias("n"), F.max(F.when(F.col("head"), F.col("value"))).alias("name")).orderBy("block", "nth").collect()
    name, at, spans = None, 0, []
    for p in parts:
        if p["nth"]:  # a header's lines; those before the first header of a block go on from the block before
            name, at = (p["name"][1:].split() or [""])[0], 0
        elif name is None and p["n"]:
            raise ValueError(f"{path}: sequence before the first header")
        spans.append((p["block"], p["nth"], name, at))
        at += p["n"]
    if name is None:
        raise ValueError(f"{path}: no sequence")
    names = Counter(x[2] for x in spans if x[1])
    if twice := sorted(n for n, k in names.items() if k > 1):
        raise ValueError(f"{path}: duplicate reference {twice[0]}")
    begins = F.broadcast(spark.createDataFrame(spans, "block long, nth long, chrom string, at long"))  # headers and blocks
    before = F.sum("n").over(Window.partitionBy("block", "nth").orderBy("ord")) - F.col("n")
    placed = lines.where("n > 0").withColumn("before", before).join(begins, ["block", "nth"])
    return placed.select("chrom", (F.col("at") + F.col("before")).alias("start"), "seq")


def reference_chunks(lines: DataFrame, contigs: DataFrame) -> DataFrame:
    """rid, chrom, start, seq, left, right of each chunk of the contigs: upper case, and the two bases on either side (N off the
    end). Every contig must be in the reference with its length; the reference may have more. A line goes to each chunk that
    has some of its bases or of their neighbours, so chunks need nothing of one another."""
    joined = lines.join(F.broadcast(contigs.select("rid", "chrom", "length")), "chrom").withColumn("end", F.col("start") + F.length("seq"))  # the header
    parts = joined.select("*", F.explode(F.expr(f"sequence(greatest(start - 2, 0L) div {CHUNK}, greatest(greatest(start - 2, 0L) div {CHUNK}, least(end + 1, length - 1) div {CHUNK}))")).alias("k"))
    parts = parts.withColumn("from", F.expr(f"greatest(start, k * {CHUNK} - 2)")).withColumn("part", F.expr(f"substring(seq, cast(`from` - start as int) + 1, cast(least(end, (k + 1) * {CHUNK} + 2) - `from` as int))"))
    chunks = parts.groupBy("rid", "chrom", "k", "length").agg(F.array_sort(F.collect_list(F.struct("from", "part"))).alias("parts"))
    own = F.expr(f"cast(least({CHUNK}, length - k * {CHUNK}) as int)")
    bases = F.concat(F.expr(f"repeat('N', cast(greatest(2 - k * {CHUNK}, 0) as int))"), F.upper(F.array_join(F.transform("parts", lambda x: x["part"]), "")))
    chunks = chunks.where(f"k * {CHUNK} < length").select("rid", "chrom", (F.col("k") * CHUNK).alias("start"), own.alias("n"), bases.alias("all"))
    return chunks.select("rid", "chrom", "start", F.expr("substring(all, 3, n)").alias("seq"), F.substring("all", 1, 2).alias("left"), F.expr("substring(rpad(all, n + 4, 'N'), n + 3, 2)").alias("right"))


def check_reference(lines: DataFrame, contigs: DataFrame) -> None:
    """Raises if a contig isn't in the reference or has another length there."""
    lengths = lines.groupBy("chrom").agg(F.sum(F.length("seq")).alias("found"))
    wrong = contigs.join(lengths, "chrom", "left").where("found is null or found <> length").orderBy("rid").first()
    if wrong:
        raise ValueError(f"reference {wrong['chrom']}: " + ("missing" if wrong["found"] is None else f"length {wrong['found']}, {wrong['length']} in the alignment"))
