"""Small alignments with results that are known in full, through the command line."""

import pytest

from cytospark import cli

# The inputs and their results.
SYNTHETIC = "ACG" * 10
READS = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:chrSynthetic\tLN:30
methylated\t0\tchrSynthetic\t1\t60\t30M\t*\t0\t0\tACGACGACGACGACGACGACGACGACGACG\t{q}\tXG:Z:CT\tNH:i:1
unmethylated\t0\tchrSynthetic\t1\t60\t30M\t*\t0\t0\tATGATGATGATGATGATGATGATGATGATG\t{q}\tXG:Z:CT\tNH:i:1
alternating\t0\tchrSynthetic\t1\t60\t30M\t*\t0\t0\tACGATGACGATGACGATGACGATGACGATG\t{q}\tXG:Z:CT\tNH:i:1
reverse-methylated\t16\tchrSynthetic\t1\t60\t30M\t*\t0\t0\tACGACGACGACGACGACGACGACGACGACG\t{q}\tXG:Z:GA\tNH:i:1
reverse-unmethylated\t16\tchrSynthetic\t1\t60\t30M\t*\t0\t0\tACAACAACAACAACAACAACAACAACAACA\t{q}\tXG:Z:GA\tNH:i:1
multimapper\t0\tchrSynthetic\t1\t60\t30M\t*\t0\t0\tACGACGACGACGACGACGACGACGACGACG\t{q}\tXG:Z:CT\tNH:i:2
duplicate\t1024\tchrSynthetic\t1\t60\t30M\t*\t0\t0\tACGACGACGACGACGACGACGACGACGACG\t{q}\tXG:Z:CT\tNH:i:1
low-mapq\t0\tchrSynthetic\t1\t5\t30M\t*\t0\t0\tACGACGACGACGACGACGACGACGACGACG\t{q}\tXG:Z:CT\tNH:i:1
""".replace("{q}", "I" * 30)
#: start, methylated, unmethylated of every site: forward ones at 1, 4 and so on, reverse ones behind them.
SITES = sorted([(p, 2 - k % 2, 1 + k % 2) for k, p in enumerate(range(1, 30, 3))] + [(p, 1, 1) for p in range(2, 30, 3)])
PER_READ = [("methylated", "100.000000"), ("unmethylated", "0.000000"), ("alternating", "50.000000"), ("reverse-methylated", "100.000000"), ("reverse-unmethylated", "0.000000"), ("duplicate", "100.000000")]
VARIANT_READS = [
    ("chrVariant", "2M", "II", [("top-clean-1", 0, "CG"), ("top-clean-2", 0, "CG"), ("top-clean-3", 0, "CG"), ("top-variant", 0, "CA"), ("bottom-clean-1", 16, "CG"), ("bottom-clean-2", 16, "CG"), ("bottom-variant-1", 16, "TG"), ("bottom-variant-2", 16, "TG"), ("bottom-unknown", 16, "NG")]),
    ("chrChg", "3M", "III", [("chg-top-clean-1", 0, "CAG"), ("chg-top-clean-2", 0, "CAG"), ("chg-top-clean-3", 0, "CAG"), ("chg-top-variant", 0, "CAA"), ("chg-bottom-clean-1", 16, "CAG"), ("chg-bottom-clean-2", 16, "CAG"), ("chg-bottom-variant-1", 16, "TAG"), ("chg-bottom-variant-2", 16, "TAG"), ("chg-bottom-unknown", 16, "NAG")]),
]
CONVERSION_READS = [("top-efficient", 0, "TAACGTAGTGAA"), ("top-half", 0, "CAACGTAGTGAA"), ("top-fail", 0, "CAACGCAGTGAA"), ("top-none", 0, "AAACGAAGTGAA"), ("bottom-efficient", 16, "CAACGCAATAAA"), ("bottom-half", 16, "CAACGCAGTAAA"), ("bottom-fail", 16, "CAACGCAGTGAA"), ("bottom-none", 16, "CAACGCATTTAA")]
CONTEXTS = """1 - CHH CNN
2 + CHH CAA
5 + CHG CAG
7 - CHG CTG
8 + CHG CCG
9 + CG CGC
10 - CG CGG
11 + CHH CTC
13 + CHG CNG
15 - CHG CNG
18 + CHH CCT
19 + CHH CTT
22 + CHH CNN"""


def sam(contigs, rows) -> str:
    head = ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{n}\tLN:{k}" for n, k in contigs)]
    return "\n".join([*head, *(f"{name}\t{flag}\t{chrom}\t1\t60\t{cigar}\t*\t0\t0\t{bases}\t{quals}\tXG:Z:{'GA' if flag else 'CT'}\tNH:i:1" for chrom, cigar, quals, own in rows for name, flag, bases in own)]) + "\n"


def indexed(path, name: str, seq: str) -> None:
    path.write_text(f">{name}\n{seq}\n")
    path.with_name(f"{path.name}.fai").write_text(f"{name}\t{len(seq)}\t{len(name) + 2}\t{len(seq)}\t{len(seq) + 1}\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("golden")
    indexed(at / "synthetic.fa", "chrSynthetic", SYNTHETIC)
    (at / "synthetic.sam").write_text(READS)
    for name, strand in (("both", ""), ("top", "\tselected\t0\t+"), ("bottom", "\tselected\t0\t-")):
        (at / f"{name}.bed").write_text(f"chrSynthetic\t4\t10{strand}\n")
    (at / "variant.fa").write_text(">chrVariant\nCG\n>chrChg\nCAG\n")
    (at / "variant.sam").write_text(sam([("chrVariant", 2), ("chrChg", 3)], VARIANT_READS))
    indexed(at / "conversion.fa", "chrConversion", "CAACGCAGTGAA")
    (at / "conversion.sam").write_text(sam([("chrConversion", 12)], [("chrConversion", "12M", "I" * 12, CONVERSION_READS)]))
    indexed(at / "contexts.fa", "chrContexts", "GCAACAGCCGCTCNGAACCTTC")
    (at / "contexts.sam").write_text(sam([("chrContexts", 22)], []))
    indexed(at / "merge.fa", "chr1", "ACGCCAGGCA")
    (at / "merge.bedGraph").write_text('track type="bedGraph"\n' + "".join("chr1\t" + "\t".join(x.split()) + "\n" for x in ("1 2 50 1 1", "2 3 100 2 0", "3 4 0 0 1", "4 5 50 1 1", "6 7 0 0 2")))
    return at


@pytest.fixture()
def run(spark, folder, tmp_path):
    def call(command: str, name: str, *more: str) -> dict[str, list[str]]:
        """The lines of the outputs, without heads of tracks, by what follows the prefix."""
        target = ["-o", str(tmp_path / "out")]
        told = cli.main([command, str(folder / f"{name}.fa"), str(folder / f"{name}.sam"), *target, *more], spark)
        read = lambda p: [x for x in open(p).read().splitlines() if not x.startswith(("track", "chrBase"))]
        return {p.removeprefix(str(tmp_path / "out")): read(p) for p in told["outputs"]}

    return call


def bed_lines(sites, chrom="chrSynthetic"):
    return [f"{chrom}\t{p}\t{p + 1}\t{100 * m // (m + u)}\t{m}\t{u}" for p, m, u in sites]


def histogram(sites):
    rows = [("OT", p + 1, m, u) for p, m, u in sites if p % 3 == 1] + [("OB", p + 1, m, u) for p, m, u in sites if p % 3 == 2]
    return ["Strand\tRead\tPosition\tnMethylated\tnUnmethylated", *(f"{s}\t1\t{p}\t{m}\t{u}" for s, p, m, u in rows)]


def report_lines(sites):
    tri = lambda p: ("+", "CGN" if p == 28 else "CGA") if p % 3 == 1 else ("-", "CGT")
    return [f"chrSynthetic\t{p + 1}\t{tri(p)[0]}\t{m}\t{u}\tCG\t{tri(p)[1]}" for p, m, u in sites]


def near(sites):
    return [x for x in sites if 4 <= x[0] < 10]


def test_counts_in_every_format(run):
    assert run("extract", "synthetic") == {"_CpG.bedGraph": bed_lines(SITES)}
    value = {"fraction": lambda m, u: f"{m / (m + u):.6f}", "counts": lambda m, u: f"{m + u}", "logit": lambda m, u: {(2, 1): "0.693147", (1, 2): "-0.693147", (1, 1): "0.000000"}[m, u]}
    for kind, suffix in (("fraction", ".meth.bedGraph"), ("counts", ".counts.bedGraph"), ("logit", ".logit.bedGraph")):
        assert run("extract", "synthetic", "--format", kind) == {f"_CpG{suffix}": [f"chrSynthetic\t{p}\t{p + 1}\t{value[kind](m, u)}" for p, m, u in SITES]}
    share = {(2, 1): " 66.67\t 33.33", (1, 2): " 33.33\t 66.67", (1, 1): " 50.00\t 50.00"}
    assert run("extract", "synthetic", "--format", "methyl-kit") == {"_CpG.methylKit": [f"chrSynthetic.{p + 1}\tchrSynthetic\t{p + 1}\t{'F' if p % 3 == 1 else 'R'}\t{m + u}\t{share[m, u]}" for p, m, u in SITES]}


def test_merged_strands_of_a_depth(run):
    spans = [(p, 3 - k % 2, 2 + k % 2) for k, p in enumerate(range(1, 30, 3))]
    assert run("extract", "synthetic", "--merge-context", "--minimum-depth", "4") == {"_CpG.bedGraph": [f"chrSynthetic\t{p}\t{p + 2}\t{20 * m}\t{m}\t{u}" for p, m, u in spans]}
    assert run("extract", "synthetic", "--merge-context", "--minimum-depth", "4", "--format", "logit") == {"_CpG.logit.bedGraph": [f"chrSynthetic\t{p}\t{p + 2}\t{'0.405465' if m == 3 else '-0.405465'}" for p, m, u in spans]}


def test_reports(run):
    assert run("extract", "synthetic", "--cytosine_report", "--chg", "--chh") == {".cytosine_report.txt": report_lines(SITES)}
    assert run("extract", "synthetic", "--format", "cytosine-report", "--chg", "--chh", "-q", "61") == {".cytosine_report.txt": report_lines([(p, 0, 0) for p, _, _ in SITES])}
    assert run("extract", "synthetic", "--format", "cytosine-report", "--chg", "--chh", "--region", "chrSynthetic:5-10") == {".cytosine_report.txt": report_lines(near(SITES))}
    zero = [x.split() for x in CONTEXTS.splitlines()]
    assert run("extract", "contexts", "--cytosine-report", "--chg", "--chh") == {".cytosine_report.txt": [f"chrContexts\t{p}\t{s}\t0\t0\t{c}\t{t}" for p, s, c, t in zero]}


def test_trimming_and_regions(run):
    fixed = [x for x in SITES if x[0] > 4 or x[0] == 2]
    assert run("extract", "synthetic", "--nOT", "5,1,1,1") == {"_CpG.bedGraph": bed_lines(fixed)}
    assert run("mbias", "synthetic", "--nOT", "5,1,1,1")["_mbias.tsv"] == histogram(fixed)
    assert run("extract", "synthetic", "--OT", "5,0,0,0") == {"_CpG.bedGraph": bed_lines([x for x in SITES if x[0] != 1])}
    assert run("extract", "synthetic", "--region", "chrSynthetic:5-10") == {"_CpG.bedGraph": bed_lines(near(SITES))}
    assert run("mbias", "synthetic", "--region", "chrSynthetic:5-10")["_mbias.tsv"] == histogram(near(SITES))
    found = run("mbias", "synthetic")
    assert found["_mbias.tsv"] == histogram(SITES) and {"_OT.svg", "_OB.svg"} < set(found)
    assert all(any(f"--{s} 0,0,0,0" in x for x in found[f"_{s}.svg"]) for s in ("OT", "OB"))


@pytest.mark.parametrize("name, strand", [("both", None), ("top", 1), ("bottom", 2)])
def test_intervals(run, folder, name, strand):
    more = ["--bed", str(folder / f"{name}.bed"), *(["--keepStrand"] if strand else [])]
    own = [x for x in near(SITES) if strand is None or x[0] % 3 == strand]
    assert run("extract", "synthetic", *more) == {"_CpG.bedGraph": bed_lines(own)}
    assert run("mbias", "synthetic", *more)["_mbias.tsv"] == histogram(own)
    reads = [x for x in PER_READ if strand is None or x[0].startswith("reverse") == (strand == 2)]
    assert run("per-read", "synthetic", *more) == {"": [f"{n}\tchrSynthetic\t0\t{v}\t10" for n, v in reads]}
    if strand is None:
        assert run("extract", "synthetic", *more, "--cytosine_report") == {".cytosine_report.txt": report_lines(own)}


def test_reads_by_their_start(run):
    every = [f"{n}\tchrSynthetic\t0\t{v}\t10" for n, v in PER_READ]
    assert run("per-read", "synthetic") == {"": every} == run("per-read", "synthetic", "--region", "chrSynthetic:1-1")
    assert run("per-read", "synthetic", "--region", "chrSynthetic:2-10") == {"": []}


def test_variants(run):
    line = lambda chrom, p, m: f"{chrom}\t{p}\t{p + 1}\t100\t{m}\t0"
    kept = lambda chrom, far: [line(chrom, 0, 4), line(chrom, far, 5)]
    at = lambda depth, fraction, *more: run("extract", "variant", "--chg", "--minOppositeDepth", depth, "--maxVariantFrac", fraction, *more)
    for depth, fraction, gone in (("4", "0.35", True), ("4", "0.6", False), ("4", "0.25", True), ("4", "0.45", True), ("5", "0.35", False)):
        assert at(depth, fraction) == {"_CpG.bedGraph": kept("chrVariant", 1)[gone:], "_CHG.bedGraph": kept("chrChg", 2)[gone:]}
    assert at("4", "0.35", "--merge-context") == {"_CpG.bedGraph": [], "_CHG.bedGraph": []}
    assert run("extract", "variant", "--minimum-opposite-depth", "4", "--maximum-variant-fraction", "0.35", "--cytosine-report") == {".cytosine_report.txt": ["chrVariant\t2\t-\t5\t0\tCG\tCGN"]}
    own = bed_lines([(3, 4, 0), (4, 4, 0)], "chrConversion"), bed_lines([(5, 1, 2), (7, 2, 1)], "chrConversion"), bed_lines([(0, 2, 1), (9, 1, 2)], "chrConversion")
    assert run("extract", "conversion", "--chg", "--chh", "--minimum-opposite-depth", "4", "--maximum-variant-fraction", "0.35") == dict(zip(("_CpG.bedGraph", "_CHG.bedGraph", "_CHH.bedGraph"), own))


@pytest.mark.parametrize("least, n", [("0.5", 3), ("0.75", 2)])
def test_conversion(run, least, n):
    assert run("extract", "conversion", "--minConversionEfficiency", least) == {"_CpG.bedGraph": bed_lines([(3, n, 0), (4, n, 0)], "chrConversion")}
    assert run("mbias", "conversion", "--minimum-conversion-efficiency", least)["_mbias.tsv"][1:] == [f"OT\t1\t4\t{n}\t0", f"OB\t1\t5\t{n}\t0"]


def test_standalone_merge(spark, folder, tmp_path):
    cli.main(["merge-context", str(folder / "merge.fa"), str(folder / "merge.bedGraph"), "-o", str(tmp_path / "out")], spark)
    assert (tmp_path / "out").read_text().splitlines() == ['track type="bedGraph" description="merged Methylation metrics"', *("chr1\t" + "\t".join(x.split()) for x in ("1 3 75 3 1", "3 4 0 0 1", "4 7 25 1 3"))]
