"""Command line: python -m cytospark.cli extract|mbias|per-read|merge-context ..."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import evidence
from .operators import mbias as bias
from .operators import sites as site_ops
from .operators.coverage import examined_columns
from .operators.filters import ReadFilter
from .operators.selection import in_region, overlapping, resolve_region
from .plans import analyses
from .plans.options import ExtractOptions, PileupOptions, Trimming, parse_bounds
from .sinks import formats, plot
from .sinks.files import Outputs, lines_of
from .sinks.release import Release
from .sources import fai
from .sources.bam import bam_contigs, read_bam
from .sources.bed import read_bed
from .sources.bedgraph import check_chromosome_order, read_metrics
from .sources.fasta import CHUNK, check_reference, read_fasta, reference_chunks
from .sources.sam import read_sam


def whole(bits: int, least: int = 0):
    """A whole number of so many bits, decimal or with 0x, 0o or 0b before it."""

    def parse(text: str) -> int:
        n = int(text, 0)
        if not least <= n < 1 << bits:
            raise argparse.ArgumentTypeError(f"{text} isn't within {least} and {(1 << bits) - 1}")
        return n

    parse.__name__ = "whole number"
    return parse


def decimal(text: str) -> int:
    """A whole number of digits alone, so that 010 is ten."""
    return whole(32)(str(int(text)) if text.isascii() and text.isdigit() else text)


def site_format(text: str) -> str:
    return {"methyl-kit": "methylkit"}.get(text, text)


def add_reads(p: argparse.ArgumentParser, per_read: bool) -> None:
    p.add_argument("reference")
    p.add_argument("input")
    p.add_argument("-r", "--region")
    p.add_argument("-l", "--bed")
    p.add_argument("--keep-bed-strand", "--keepStrand", action="store_true")
    p.add_argument("-q", "--minimum-mapping-quality", type=whole(8), default=10)
    p.add_argument("-p", "--minimum-base-quality", type=whole(8), default=5)
    p.add_argument("-F", "--ignore-flags", type=whole(16), default=0 if per_read else 0xF00)
    p.add_argument("-R", "--require-flags", type=whole(16), default=0)
    p.add_argument("--ignore-nh", action="store_true")
    p.add_argument("--json", action="store_true")


def add_pileup(p: argparse.ArgumentParser) -> None:
    add_reads(p, False)
    p.add_argument("-o", "--output-prefix", required=True)
    p.add_argument("--release", metavar="FOLDER", help="write the outputs as a version of a folder on any Hadoop file system")
    p.add_argument("--minimum-conversion-efficiency", "--minConversionEfficiency", type=float, default=0.0)
    for name in ("duplicates", "singletons", "discordant"):
        p.add_argument(f"--keep-{name}", action="store_true")
    p.add_argument("--no-cpg", action="store_true")
    p.add_argument("--chg", action="store_true")
    p.add_argument("--chh", action="store_true")
    for strand in ("OT", "OB", "CTOT", "CTOB"):
        p.add_argument(f"--{strand.lower()}", f"--{strand}", dest=f"keep_{strand}", type=parse_bounds)
        p.add_argument(f"--trim-{strand.lower()}", f"--n{strand}", dest=f"trim_{strand}", type=parse_bounds)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cytospark", allow_abbrev=False)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("extract", allow_abbrev=False)
    add_pileup(p)
    p.add_argument("--format", type=site_format, choices=[*formats.SUFFIXES, "cytosine-report"])
    p.add_argument("--cytosine-report", "--cytosine_report", action="store_true")
    p.add_argument("--merge-context", action="store_true")
    p.add_argument("-d", "--minimum-depth", type=decimal, default=1)
    p.add_argument("--minimum-opposite-depth", "--minOppositeDepth", type=decimal, default=0)
    p.add_argument("--maximum-variant-fraction", "--maxVariantFrac", type=float, default=0.0)
    add_pileup(sub.add_parser("mbias", allow_abbrev=False))
    p = sub.add_parser("per-read", allow_abbrev=False)
    add_reads(p, True)
    p.add_argument("-o", "--output")
    p = sub.add_parser("merge-context", allow_abbrev=False)
    p.add_argument("reference")
    p.add_argument("input")
    p.add_argument("-o", "--output")
    p.add_argument("--json", action="store_true")
    return top


def load(spark: SparkSession, args: argparse.Namespace, exhaustive: bool = False) -> tuple[DataFrame, DataFrame, list, DataFrame | None, tuple | None]:
    """reads, reference chunks, contigs, intervals and region. With indexes beside them, of the alignment only the reads that overlap
    the region are read, and of the reference only the chunks that these touch (exhaustive: and those of the region)."""
    if args.input.endswith(".cram"):
        raise ValueError("CRAM isn't supported")
    if args.keep_bed_strand and not args.bed:
        raise ValueError("--keep-bed-strand needs --bed")
    if args.input.endswith(".bam"):
        known = bam_contigs(args.input)
        region = resolve_region(args.region, known) if args.region else None
        reads, contigs = read_bam(spark, args.input, region)
    else:
        reads, contigs = read_sam(spark, args.input)
        known = [tuple(r) for r in contigs.orderBy("rid").collect()]
        region = resolve_region(args.region, known) if args.region else None
    bed = read_bed(spark, args.bed, contigs, args.keep_bed_strand) if args.bed else None
    return reads, load_reference(spark, args.reference, reads, contigs, known, region, exhaustive), known, bed, region


def load_reference(spark: SparkSession, path: str, reads: DataFrame, contigs: DataFrame, known: list, region: tuple | None, exhaustive: bool) -> DataFrame:
    if not fai.indexed(path):
        lines = read_fasta(spark, path)
        check_reference(lines, contigs)
        return reference_chunks(lines, contigs)
    fai.check_index(fai.read_index(path), known)
    wanted = None
    if region:
        wanted = fai.touched(overlapping(evidence.aligned(reads.where("(flag & 4) = 0")), region))
        wanted = wanted.unionByName(fai.within(*region, spark)) if exhaustive else wanted
    return fai.indexed_chunks(spark, path, known, wanted)


def read_filter(args: argparse.Namespace, preset=ReadFilter) -> ReadFilter:
    names = ("minimum_mapping_quality", "ignore_flags", "require_flags", "ignore_nh", "keep_duplicates", "keep_singletons", "keep_discordant")
    return preset(**{n: getattr(args, n) for n in names if hasattr(args, n)})


def pileup_options(args: argparse.Namespace) -> dict:
    bounds = lambda kind: {s: b for s in ("OT", "OB", "CTOT", "CTOB") if (b := getattr(args, f"{kind}_{s}"))}
    contexts = tuple(c for c, on in (("CG", not args.no_cpg), ("CHG", args.chg), ("CHH", args.chh)) if on)
    return {"reads": read_filter(args), "minimum_base_quality": args.minimum_base_quality, "minimum_conversion_efficiency": args.minimum_conversion_efficiency, "contexts": contexts, "trimming": Trimming(bounds("keep"), bounds("trim"))}


def outputs_of(spark: SparkSession, args: argparse.Namespace) -> Outputs | Release:
    return Release(spark, args.release) if args.release else Outputs([args.reference, args.input, args.bed])


def report(operation: str, outputs: list[str], **counts: int) -> dict:
    zero = {"input_records": 0, "output_records": 0, "filtered_records": 0, "excluded_variant_sites": 0, "merged_records": 0}
    return {"operation": operation} | zero | {k: int(v) for k, v in counts.items()} | {"outputs": outputs}


def extract(spark: SparkSession, args: argparse.Namespace) -> dict:
    options = ExtractOptions(**pileup_options(args), minimum_depth=args.minimum_depth, minimum_opposite_depth=args.minimum_opposite_depth, maximum_variant_fraction=args.maximum_variant_fraction)
    if args.cytosine_report and args.format:
        raise ValueError("--cytosine-report and --format exclude one another")
    args.cytosine_report |= args.format == "cytosine-report"
    if args.merge_context and (args.cytosine_report or args.format == "methylkit"):
        raise ValueError("this format can't be merged")
    kind, contexts = args.format or "standard", options.contexts
    reads, reference, _, bed, region = load(spark, args, args.cytosine_report)
    counted = analyses.site_counts(reads, reference, options, bed, region, exhaustive=args.cytosine_report).persist()
    kept = counted.where(~F.col("excluded"))
    with outputs_of(spark, args) as out:
        merged = 0
        if args.cytosine_report:
            out.write(f"{args.output_prefix}.cytosine_report.txt", [], formats.report_lines(kept), ("rid", "at"))
            written = kept.count()
        else:
            if args.merge_context:
                every = site_ops.merged_sites(counted)
                merged = every.where("n > 1").count()
                rows = every.where(F.col("m") + F.col("u") >= args.minimum_depth)
            else:
                rows = kept.where(F.col("m") + F.col("u") >= args.minimum_depth).select("*", F.col("pos").alias("s"), (F.col("pos") + 1).alias("e"))
            for ctx in contexts:
                head = formats.header(kind, args.output_prefix, ctx, args.merge_context)
                lines = formats.site_lines(rows.where(F.col("ctx") == ctx), kind)
                out.write(f"{args.output_prefix}_{formats.NAMES[ctx]}{formats.SUFFIXES[kind]}", [head], lines, ("rid", "at", "upto"))
            written = rows.count()
        counts = analyses.read_counters(reads, reference, options, region).first().asDict()
        examined = examined_columns(analyses.passing(reads, reference, options), region).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        excluded = counted.where("excluded").count()
        outputs = out.commit()
    counted.unpersist()
    return report("extract", outputs, output_records=written, excluded_variant_sites=excluded, merged_records=merged, **counts) | {"examined_columns": int(examined)}


def mbias(spark: SparkSession, args: argparse.Namespace) -> dict:
    options = PileupOptions(**pileup_options(args))
    reads, reference, _, bed, region = load(spark, args)
    rows = analyses.mbias(reads, reference, options, bed, region).persist()
    told = bias.in_order(bias.with_intervals(rows)).collect()  # a few for each place in a read
    found = {r["strand"]: list(r["bounds"]) for r in bias.suggestions(rows).collect()}
    with outputs_of(spark, args) as out:
        table = ["Strand\tRead\tPosition\tnMethylated\tnUnmethylated"] + [f"{r['strand']}\t{r['read']}\t{r['position']}\t{r['m']}\t{r['u']}" for r in told]
        out.write(f"{args.output_prefix}_mbias.tsv", table)
        for strand, bounds in found.items():
            out.write(f"{args.output_prefix}_{strand}.svg", [plot.mbias_svg(strand, [r for r in told if r["strand"] == strand], bounds)])
        counts = analyses.read_counters(reads, reference, options, region).first().asDict()
        outputs = out.commit()
    rows.unpersist()
    return report("mbias", outputs, output_records=len(told), **counts) | {"calls": sum(r["m"] + r["u"] for r in told), "suggestions": found}


def to_output(args: argparse.Namespace, head: list[str], rows: DataFrame, order: tuple[str, ...], inputs: list[str]) -> list[str]:
    """Writes to the file named, or to standard output, a partition at a time."""
    if not args.output or args.output == "-":
        if args.json:
            raise ValueError("--json needs an output file")
        for part in (head, lines_of(rows, *order)):
            sys.stdout.writelines(f"{line}\n" for line in part)
        return []
    with Outputs(inputs) as out:
        out.write(args.output, head, rows, order)
        return out.commit()


def per_read(spark: SparkSession, args: argparse.Namespace) -> dict:
    if args.minimum_base_quality < 1:
        raise ValueError("the minimum base quality must be positive")
    reads, reference, _, bed, region = load(spark, args)
    rows = analyses.per_read(reads, reference, read_filter(args, ReadFilter.per_read), args.minimum_base_quality, bed, region).persist()
    outputs = to_output(args, [], formats.per_read_lines(rows), ("ord",), [args.reference, args.input, args.bed])
    n, m = in_region(reads, region, "start").count(), rows.count()
    rows.unpersist()
    return report("per-read", outputs, input_records=n, output_records=m, filtered_records=n - m)


def merge_context(spark: SparkSession, args: argparse.Namespace) -> dict:
    spooled = None
    if args.input == "-":
        with tempfile.NamedTemporaryFile("wb", suffix=".bedGraph", delete=False) as f:
            shutil.copyfileobj(sys.stdin.buffer, f)
            args.input = spooled = f.name
    try:
        metrics = read_metrics(spark, args.input)
        check_chromosome_order(metrics, args.input)
        if fai.indexed(args.reference):
            known = [(i, name, length) for i, (name, length, *_) in enumerate(fai.read_index(args.reference))]
            at = spark.createDataFrame([(i, n) for i, n, _ in known], "rid int, chrom string")  # the index
            wanted = metrics.join(F.broadcast(at), "chrom").select("rid", F.floor(F.col("start") / CHUNK).alias("k"))
            reference = fai.indexed_chunks(spark, args.reference, known, wanted)
        else:
            lines = read_fasta(spark, args.reference)
            contigs = lines.groupBy("chrom").agg(F.max(F.col("start") + F.length("seq")).alias("length")).withColumn("rid", F.row_number().over(Window.orderBy("chrom")).cast("int"))
            reference = reference_chunks(lines, contigs)
        rows = analyses.merge_context(metrics, reference)
        first = rows.groupBy("chrom").agg(F.min("first").alias("first"))
        text = formats.merged_lines(rows).drop("first").join(first, "chrom")
        head = ['track type="bedGraph" description="merged Methylation metrics"']
        outputs = to_output(args, head, text, ("first", "s", "e"), [args.reference, args.input])
        n, m, both = metrics.count(), rows.count(), rows.where("n > 1").count()
        return report("merge-context", outputs, input_records=n, output_records=m, merged_records=both)
    finally:
        if spooled:
            os.unlink(spooled)


COMMANDS = {"extract": extract, "mbias": mbias, "per-read": per_read, "merge-context": merge_context}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("cytospark").getOrCreate()
    found = COMMANDS[args.command](spark, args)
    if args.json:
        print(json.dumps(found))
    return found


if __name__ == "__main__":
    main()
