"""extract, mbias, per_read and merge_context over DataFrames of reads, cytosines and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, mbias as bias, sites
from ..operators.context import CELL, at_places, cells, spans
from ..operators.filters import ReadFilter, converted_enough
from ..operators.pileup import pileup
from ..operators.selection import Region, by_cells, in_region, overlapping, touching
from .options import ExtractOptions, PileupOptions


def passing(reads: DataFrame, reference: DataFrame, options: PileupOptions) -> DataFrame:
    """aligned() reads that pass the filters; the one of conversion looks at whole reads, whatever is trimmed or selected."""
    rows = evidence.aligned(reads.where(options.reads.passes()))
    if not options.minimum_conversion_efficiency:
        return rows
    bases = evidence.at_cytosines(evidence.strict(rows), reference, ["ord", "rid", "top"], ("CHG", "CHH"), informative=True)
    return converted_enough(rows, evidence.calls(bases, options.minimum_base_quality), options.minimum_conversion_efficiency)


def site_counts(reads: DataFrame, reference: DataFrame, options: ExtractOptions, bed: DataFrame | None = None, region: Region | None = None, exhaustive: bool = False) -> DataFrame:
    """Every selected cytosine of the reference's chunks with a read over it (exhaustive: without, too), with its counts and whether
    it is excluded as a variant. Bases at cytosines are trimmed, then adjusted where mates overlap, then selected by quality
    and interval."""
    rows, gaps = overlapping(passing(reads, reference, options), region), options.minimum_depth == 0
    bounds = (options.trimming.inclusion, options.trimming.fixed)
    beds = None if bed is None else by_cells(bed)
    counts = pileup(rows, reference, options.contexts, options.minimum_base_quality, bounds, region, beds, options.paired, gaps, exhaustive, options.deep)
    return sites.judged(counts, options.minimum_opposite_depth, options.maximum_variant_fraction)


def extract(reads: DataFrame, reference: DataFrame, options: ExtractOptions = ExtractOptions(), bed: DataFrame | None = None, region: Region | None = None) -> DataFrame:
    """Sites that aren't excluded, of the minimum depth."""
    return site_counts(reads, reference, options, bed, region).where(~F.col("excluded") & (F.col("m") + F.col("u") >= options.minimum_depth))


def extract_events(reads: DataFrame, reference: DataFrame, options: ExtractOptions = ExtractOptions(), bed: DataFrame | None = None, region: Region | None = None) -> DataFrame:
    """Sites of the minimum depth and, marked as excluded, variants."""
    return site_counts(reads, reference, options, bed, region).where(F.col("excluded") | (F.col("m") + F.col("u") >= options.minimum_depth))


def extract_merged(reads: DataFrame, reference: DataFrame, options: ExtractOptions = ExtractOptions(), bed: DataFrame | None = None, region: Region | None = None) -> DataFrame:
    """Both strands' counts of each CpG and CHG; the depth counts after merging."""
    return sites.merged_sites(site_counts(reads, reference, options, bed, region), options.minimum_depth)


def cytosine_report(reads: DataFrame, reference: DataFrame, options: ExtractOptions = ExtractOptions(), bed: DataFrame | None = None, region: Region | None = None) -> DataFrame:
    """Every cytosine of the contexts, covered or not, but for excluded ones."""
    return site_counts(reads, reference, options, bed, region, exhaustive=True).where(~F.col("excluded"))


def mbias(reads: DataFrame, reference: DataFrame, options: PileupOptions = PileupOptions(), bed: DataFrame | None = None, region: Region | None = None) -> DataFrame:
    """Calls by strand, read and position in the read, with raw qualities."""
    rows = evidence.strict(overlapping(passing(reads, reference, options), region))
    bases = evidence.at_cytosines(rows, reference, ["rid", "strand", "top", "read", F.length("bases").alias("length")], options.contexts, informative=True, beds=None if bed is None else by_cells(bed))
    bases = evidence.trimmed(in_region(bases, region), options.trimming.inclusion, options.trimming.fixed)
    return bias.histogram(evidence.calls(bases, options.minimum_base_quality))


def per_read(reads: DataFrame, reference: DataFrame, filter: ReadFilter = ReadFilter.per_read(), minimum_base_quality: int = 5, bed: DataFrame | None = None, region: Region | None = None) -> DataFrame:
    """ord, name, rid, chrom, start, m, u of each read that passes, with or without CpG calls. A region selects reads by their
    start, a BED those that overlap it."""
    rows = touching(evidence.strict(evidence.aligned(in_region(reads, region, "start").where(filter.passes()))), bed)
    found = evidence.calls(evidence.at_cytosines(rows, reference, ["ord", "rid", "top"], ("CG",), informative=True), minimum_base_quality)
    counts = found.groupBy("ord").agg(F.count_if("meth").alias("m"), F.count_if(~F.col("meth")).alias("u"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("ord", "name", "rid", "chrom", "start").join(counts, "ord", "left").select("ord", "name", "rid", "chrom", "start", zero("m"), zero("u"))


def site_spans(metrics: DataFrame, reference: DataFrame) -> DataFrame:
    """metrics (chrom, start and more) with s and e, their CpG, CHG or single span. They look up their own place in the reference's cells,
    so cytosines never become rows; a metric at no cytosine is an error."""
    own = cells(reference).select("chrom", "cell", "first", "around")
    at = metrics.withColumn("cell", F.expr(f"start div {CELL}")).join(own, ["chrom", "cell"], "left")
    place = (F.col("start") - F.col("first")).cast("int")
    known = (place < F.length("around") - 4) & F.substring("around", place + 3, F.lit(1)).cast("string").isin("C", "G")
    wrong = F.raise_error(F.concat(F.lit("no cytosine at "), F.col("chrom"), F.lit(":"), F.col("start").cast("string"))).cast("int")
    at = at.select(*metrics.columns, F.col("start").alias("pos"), F.coalesce("around", F.lit(b"NNNNN")).alias("around"), F.when(F.coalesce(known, F.lit(False)), place).otherwise(wrong).alias("k"))
    return spans(at_places(at, "k", [*metrics.columns, "pos"]))


def merge_context(metrics: DataFrame, reference: DataFrame) -> DataFrame:
    """chrom, s, e, m, u, first, n: site metrics (ord, chrom, start, methylated, unmethylated) added up over their CpG and CHG spans; a
    metric at no cytosine is an error. first orders chromosomes as in the input."""
    rows = site_spans(metrics, reference)
    return rows.groupBy("chrom", "s", "e").agg(F.sum("methylated").alias("m"), F.sum("unmethylated").alias("u"), F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))


def read_counters(reads: DataFrame, reference: DataFrame, options: PileupOptions, region: Region | None = None) -> DataFrame:
    """One row: input_records, filtered_records."""
    rows = overlapping(evidence.aligned(reads), region) if region else reads
    kept = overlapping(passing(reads, reference, options), region)
    both = rows.select(F.lit(1).alias("n"), F.lit(1).alias("lost")).unionByName(kept.select(F.lit(0).alias("n"), F.lit(-1).alias("lost")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_records"), F.coalesce(F.sum("lost"), F.lit(0)).alias("filtered_records"))
