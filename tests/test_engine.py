import gzip
import io
import os
import random
import struct
import subprocess
import sys
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cytospark import cli, testdata
from cytospark.functions.reads import bisulfite_strand, cigar_walk
from cytospark.functions.stats import log_odds, percentage
from cytospark.functions.text import exact_percentage, fixed
from cytospark.operators.context import cells, cytosines
from cytospark.operators.filters import ReadFilter
from cytospark.operators.mbias import suggestions
from cytospark.operators.overlap import adjusted
from cytospark.operators.selection import resolve_region
from cytospark.plans import analyses
from cytospark.plans.options import ExtractOptions, PileupOptions, Trimming, parse_bounds
from cytospark.sinks.files import Outputs
from cytospark.sources import bed as bed_source
from cytospark.sources import fasta as fasta_source
from cytospark.sources.bam import BamReader, read_bam
from cytospark.sources.bedgraph import check_chromosome_order, read_metrics
from cytospark.sources.fasta import check_reference, read_fasta, reference_chunks
from cytospark.sources.sam import read_sam
from cytospark.streaming.mbias import stream_mbias, stream_sam

from . import samples

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
ALL = ("CG", "CHG", "CHH")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    reads = samples.random_reads(160, 7)
    (at / "reads.sam").write_text(samples.sam(reads))
    (at / "ref.fa").write_text(samples.fasta())
    return at, reads


@pytest.fixture(scope="module")
def loaded(spark, files):
    at, rows = files
    reads, contigs = read_sam(spark, str(at / "reads.sam"))
    reference = reference_chunks(read_fasta(spark, str(at / "ref.fa")), contigs).persist()
    return reads, contigs, reference, rows


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q)); assert set(o) <= set(q) and 'extract_cpg' in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 41


def test_context_of_every_base(spark, loaded, monkeypatch, files):
    _, contigs, reference, _ = loaded
    want = {(r, i, *c) for r, s in enumerate(samples.CONTIGS.values()) for i in range(len(s)) if (c := samples.context_of(s, i))}
    assert {(r["rid"], r["pos"], r["fwd"], r["ctx"], r["tri"]) for r in cytosines(reference).collect()} == want
    for chunk in (1, 10):  # contexts across the edges of chunks
        monkeypatch.setattr(fasta_source, "CHUNK", chunk)
        small = cytosines(reference_chunks(read_fasta(spark, str(files[0] / "ref.fa")), contigs))
        assert {(r["rid"], r["pos"], r["fwd"], r["ctx"], r["tri"]) for r in small.collect()} == want


def test_cells_have_a_byte_for_each_base(spark):
    seq = "ACgRC\u00e9GC\U0001f600CCG"
    chunks = spark.createDataFrame([(0, "x", 0, seq, "NN", "NN")], "rid int, chrom string, start long, seq string, left string, right string")
    assert dict(cells(chunks).dtypes)["around"] == "binary"
    assert [bytes(r["around"]) for r in cells(chunks).collect()] == [b"NNACGNCNGCNCCGNN"]
    want = {(i, *c) for i in range(len(seq)) if (c := samples.context_of(seq.upper(), i))}
    assert {(r["pos"], r["fwd"], r["ctx"], r["tri"]) for r in cytosines(chunks).collect()} == want


def test_contigs_of_the_queries_are_made_of_whole_texts(spark, tmp_path):
    texts = ["caf\u00e9 \U0001f600\n\u4e2d\x00z", "", None, "xyz" * 6000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = testdata.contigs(spark, str(tmp_path))
    seqs = {}
    for r in found.orderBy("rid", "start").collect():
        assert r["start"] == len(seqs.get(r["rid"], ""))
        seqs[r["rid"]] = seqs.get(r["rid"], "") + r["seq"]
    assert seqs == {k: "".join(testdata.LETTERS[ord(c) % 10] for c in t) for k, t in enumerate(texts) if t}
    assert "transform" not in found._jdf.queryExecution().toString()  # no walk over characters as array elements


def test_sites_against_a_sequential_model(loaded):
    reads, _, reference, rows = loaded
    want = samples.model(rows)
    found = analyses.site_counts(reads, reference, ExtractOptions(contexts=ALL)).collect()
    got = {(r["rid"], r["pos"]): {k: r[k] for k in ("fwd", "ctx", "m", "u", "opposite", "variant")} for r in found}
    used = {k for k, v in want.items() if v["m"] + v["u"] + v["opposite"]}
    assert used <= set(got) <= set(want)
    assert all(got[k] == want[k] for k in used)
    # strict: a fraction that equals the limit stays; the depth counts only usable bases
    options = ExtractOptions(contexts=ALL, minimum_opposite_depth=2, maximum_variant_fraction=0.5)
    out = {(r["rid"], r["pos"]) for r in analyses.site_counts(reads, reference, options).where("excluded").collect()}
    assert out == {k for k, v in want.items() if v["opposite"] >= 2 and v["variant"] / v["opposite"] > 0.5} and out


def test_merging_drops_spans_with_an_excluded_site(loaded):
    reads, _, reference, rows = loaded
    options = ExtractOptions(contexts=ALL, minimum_opposite_depth=1, maximum_variant_fraction=0.4, minimum_depth=2)
    spans, gone = {}, set()
    for (rid, p), v in samples.model(rows).items():
        w = {"CG": 2, "CHG": 3, "CHH": 1}[v["ctx"]]
        s = p if v["fwd"] else p - w + 1
        key = (rid, v["ctx"], s, s + w)
        if v["opposite"] >= 1 and v["variant"] / v["opposite"] > 0.4:
            gone.add(key)
        m, u = spans.get(key, (0, 0))
        spans[key] = (m + v["m"], u + v["u"])
    want = {k: v for k, v in spans.items() if k not in gone and sum(v) >= 2}
    got = {(r["rid"], r["ctx"], r["s"], r["e"]): (r["m"], r["u"]) for r in analyses.extract_merged(reads, reference, options).collect()}
    assert got == want


def test_report_has_every_cytosine(loaded):
    reads, _, reference, rows = loaded
    want = samples.model(rows)
    got = {(r["rid"], r["pos"]): (r["m"], r["u"]) for r in analyses.cytosine_report(reads, reference, ExtractOptions(contexts=ALL)).collect()}
    assert len(got) == cytosines(reference).count()
    assert all(v == ((want[k]["m"], want[k]["u"]) if k in want else (0, 0)) for k, v in got.items())


def test_report_looks_counts_up_by_place(loaded):
    reads, _, reference, rows = loaded
    report = lambda **o: analyses.cytosine_report(reads, reference, ExtractOptions(contexts=("CG", "CHH"), **o), region=(0, 3, 50)).select("pos", "ctx", "m", "u")
    want = sorted((p, v["ctx"], v["m"], v["u"]) for (rid, p), v in samples.model(rows).items() if rid == 0 and 3 <= p < 50 and v["ctx"] != "CHG")
    for options in ({}, {"deep": 2}):
        out = report(**options)
        assert [r for r in sorted(map(tuple, out.collect())) if r[2] + r[3]] == [r for r in want if r[2] + r[3]]
        assert out.count() == cytosines(reference).where("rid = 0 and pos >= 3 and pos < 50 and ctx <> 'CHG'").count()
    # cytosines without reads don't go through the counting
    assert "Union" not in report()._jdf.queryExecution().optimizedPlan().toString()


def test_deep_cells_of_the_queries_are_split(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plain = testdata.queries()["percentage"](spark, SF)
    assert "salt" not in plan(plain)  # no cell is deep, so nothing moves twice
    assert "entries" not in plan(plain)  # no list of a fragment's bases is made at each place
    monkeypatch.setattr(testdata, "DEEP", 20)
    split = testdata.queries()["percentage"](spark, SF)
    assert "salt" in plan(split)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.collect()))


def test_histogram_and_reads_against_the_model(loaded):
    reads, _, reference, rows = loaded
    seqs = list(samples.CONTIGS.values())
    hist, each = {}, []
    for r in rows:
        strand = samples.strand_of(r["flag"], r["xg"])
        top = strand in ("OT", "CTOT")
        calls = [(q, c[1], b) for q, p, b, k in samples.bases_of(r) if k >= 5 and (c := samples.context_of(seqs[r["rid"]], p)) and c[0] == top and b in ("CT" if top else "GA")]
        if samples.passes(r):
            for q, ctx, b in calls:
                if ctx == "CG":
                    cell = hist.setdefault((strand, 2 if r["flag"] & 128 else 1, q + 1), [0, 0])
                    cell[b not in "CG"] += 1
        if not r["flag"] & 4 and r["mapq"] >= 10 and (r["nh"] or 0) <= 1:
            own = [b for _, ctx, b in calls if ctx == "CG"]
            each.append((r["name"], r["start"], sum(b in "CG" for b in own), sum(b in "TA" for b in own)))
    got = {(r["strand"], r["read"], r["position"]): [r["m"], r["u"]] for r in analyses.mbias(reads, reference).collect()}
    assert got == hist
    assert [(r["name"], r["start"], r["m"], r["u"]) for r in analyses.per_read(reads, reference).orderBy("ord").collect()] == each


def test_conversion_filter_is_inclusive(loaded):
    reads, _, reference, rows = loaded
    seqs, want = list(samples.CONTIGS.values()), 0
    for r in rows:
        top = samples.strand_of(r["flag"], r["xg"]) in ("OT", "CTOT")
        told = [b for _, p, b, k in samples.bases_of(r) if k >= 5 and (c := samples.context_of(seqs[r["rid"]], p)) and c[0] == top and c[1] != "CG" and b in ("CT" if top else "GA")]
        want += samples.passes(r) and (not told or sum(b in "TA" for b in told) / len(told) >= 0.5)
    assert analyses.passing(reads, reference, PileupOptions(minimum_conversion_efficiency=0.5)).count() == want


def test_strands_of_all_flags(spark):
    rows = [(f, x) for f in range(256) for x in (None, "CT", "GA", "N")]
    got = spark.createDataFrame(rows, "flag int, xg string").withColumn("s", bisulfite_strand(F.col("flag"), F.col("xg"))).collect()
    for r in got:
        told = r["xg"] in ("CT", "GA") or not r["flag"] & 1 or r["flag"] & 0xC0 or r["flag"] & 0x50 == 0x50
        assert r["s"] == (samples.strand_of(r["flag"], r["xg"] if r["xg"] != "N" else None) if told else None), r


def test_cigars(spark):
    rows = [("5M", 5, 5), ("2S3M1I2D4M3N1X1=2H", 12, 14), ("3M2", None, None), ("*", None, None), ("0M4M", 4, 4), ("2M1P2M", 4, 4)]
    got = spark.createDataFrame(rows, "c string, q long, r long").withColumn("w", cigar_walk(F.col("c"), F.lit(0))).collect()
    for r in got:
        assert (r["w"] and (r["w"]["qlen"], r["w"]["stop"])) == ((r["q"], r["r"]) if r["q"] else None), r


def test_a_cigar_must_use_up_the_bases(spark, loaded):
    _, _, reference, _ = loaded
    bad = spark.createDataFrame([(0, "x", 0, 0, "zeta", 0, 60, "4M", "ACG", "III", None, None)], "ord long, name string, flag int, rid int, chrom string, start long, mapq int, cigar string, bases string, quals string, xg string, nh string")
    with pytest.raises(Exception, match="invalid CIGAR"):
        analyses.per_read(bad, reference).collect()


def test_overlap_rule_on_random_columns(spark):
    rng = random.Random(3)
    rows = [(k % 9, f"n{rng.randrange(12)}", k, rng.random() < 0.8, rng.choice("ACGTN"), rng.choice([0, 4, 5, 30, 30, 250, 255]), rng.random() < 0.9) for k in range(900)]
    df = spark.createDataFrame(rows, "pos long, name string, ord long, top boolean, base string, qual int, eligible boolean").withColumn("rid", F.lit(0))
    waiting, want = {}, {r[2]: r[5] for r in rows}
    for pos, name, ord_, top, base, qual, eligible in rows:
        if eligible:
            if other := waiting.pop((pos, name), None):
                want[other[0]], want[ord_] = samples.adjust(other[1], (top, base, qual))
            else:
                waiting[pos, name] = (ord_, (top, base, qual))
    assert {r["ord"]: r["qual"] for r in adjusted(df).collect()} == want


def test_suggestion_keeps_the_even_part(spark):
    rows = [("OT", 1, i + 1, 50 if 1 <= i <= 8 else 98, 50 if 1 <= i <= 8 else 2) for i in range(10)] + [("OB", 2, 1, 3, 1)]
    got = {r["strand"]: list(r["bounds"]) for r in suggestions(spark.createDataFrame(rows, "strand string, read int, position long, m long, u long")).collect()}
    assert got == {"OT": [2, 9, 0, 0], "OB": [0, 0, 0, 0]}


def test_numbers_as_text(spark):
    pairs = [(m, n) for n in (1, 3, 7, 32, 128, 1024) for m in range(n + 1)]
    df = spark.createDataFrame(pairs, "m long, n long")
    from decimal import ROUND_HALF_EVEN, Decimal, getcontext

    getcontext().prec = 60
    for r in df.withColumn("t", exact_percentage(F.col("m"), F.col("n"))).withColumn("f", fixed(F.col("m") / F.col("n"), 6)).collect():
        assert r["t"] == str((Decimal(100 * r["m"]) / r["n"]).quantize(Decimal("0.000001"), ROUND_HALF_EVEN)), r
        assert r["f"] == f"{r['m'] / r['n']:.6f}"
    ends = spark.createDataFrame([(0, 3), (3, 0), (1, 1), (0, 0)], "m long, u long").select(log_odds(F.col("m"), F.col("u")).alias("x"), percentage(F.col("m"), F.col("u")).alias("p")).collect()
    assert [(r["x"], r["p"]) for r in ends] == [(float("-inf"), 0), (float("inf"), 100), (0.0, 50), (None, 0)]


def test_bed(spark):
    known = [(0, "zeta", 61), (1, "alpha", 31)]
    text = b"# c\ntrack x\nbrowser y\n\nzeta 5 9 a 0 +\nzeta\t9\t12\tb\t0\t+\nzeta 20 30 c 0 -\nalpha 3 99\n"
    rows = bed_source.parse_bed(text, "x.bed", known, keep_strand=True)
    assert rows == bed_source.parse_bed(gzip.compress(text[:40]) + gzip.compress(text[40:]), "x.bed", known, keep_strand=True)
    merged = {tuple(r) for r in bed_source.merged(spark.createDataFrame(rows, bed_source.BED)).collect()}
    assert merged == {(0, True, 5, 12), (0, False, 20, 30), (1, True, 3, 31), (1, False, 3, 31)}
    for bad, what in ((b"zeta 1\n", "three fields"), (b"\nbeta 1 2\n", "x.bed:2: unknown reference"), (b"zeta a 2", "whole"), (b"zeta 3 3", "before"), (b"zeta 61 70", "beyond"), (b"zeta 1 2 a 0 x", "unknown strand")):
        with pytest.raises(ValueError, match=what):
            bed_source.parse_bed(bad, "x.bed", known, keep_strand=True)


def test_bed_files_are_parsed_by_tasks(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "zeta", 61), (1, "alpha", 31)], "rid int, chrom string, length long")
    text = "# c\ntrack x\n\nzeta 5 9 a 0 +\nzeta\t9\t12\tb\t0\t+\nzeta 20 30 c 0 -\nalpha 3 99\n"
    want = {(0, True, 5, 12), (0, False, 20, 30), (1, True, 3, 31), (1, False, 3, 31)}
    (tmp_path / "a.bed").write_text(text)
    for name in ("a.bed.gz", "packed"):  # told by name, and by its first bytes
        (tmp_path / name).write_bytes(gzip.compress(text[:40].encode()) + gzip.compress(text[40:].encode()))
    (tmp_path / "empty.bed").write_text("")
    for name in ("a.bed", "a.bed.gz", "packed"):
        assert {tuple(r) for r in bed_source.read_bed(spark, str(tmp_path / name), contigs, True).collect()} == want
    assert bed_source.read_bed(spark, str(tmp_path / "empty.bed"), contigs).count() == 0
    (tmp_path / "bad.bed").write_text("zeta 1 2\n\nbeta 1 2\nzeta 3 3\n")
    with pytest.raises(ValueError, match="bad.bed:3: unknown reference beta"):
        bed_source.read_bed(spark, str(tmp_path / "bad.bed"), contigs)


def test_bed_and_region_select(spark, loaded):
    reads, contigs, reference, rows = loaded
    want = samples.model(rows)
    empty = spark.createDataFrame([], bed_source.BED)
    assert analyses.extract(reads, reference, ExtractOptions(contexts=ALL), empty).count() == 0
    both = spark.createDataFrame([(0, t, 10, 40) for t in (True, False)], bed_source.BED)
    inside = {k for k, v in want.items() if k[0] == 0 and 10 <= k[1] < 40 and v["m"] + v["u"]}
    assert {(r["rid"], r["pos"]) for r in analyses.extract(reads, reference, ExtractOptions(contexts=ALL), both).collect()} == inside
    assert {(r["rid"], r["pos"]) for r in analyses.extract(reads, reference, ExtractOptions(contexts=ALL), region=(0, 10, 40)).collect()} == inside
    top = analyses.site_counts(reads, reference, ExtractOptions(contexts=ALL), both.where("top"))
    assert top.where("not fwd or opposite > 0").count() == 0 and top.count()
    known = [tuple(r) for r in contigs.collect()]
    assert resolve_region("zeta", known) == (0, 0, 61) and resolve_region("alpha:5", known) == (1, 4, 5) and resolve_region("zeta:1-999", known) == (0, 0, 61)
    for bad in ("beta:1-2", "zeta:9-3", "zeta:0-0", "alpha:99-100"):
        with pytest.raises(ValueError):
            resolve_region(bad, known)


def test_trimming(loaded):
    reads, _, reference, _ = loaded
    cut = analyses.mbias(reads, reference, PileupOptions(contexts=ALL, trimming=Trimming({"OT": (3, 6, 0, 0)}, {"OB": (2, 0, 0, 0)}))).collect()
    every = {(r["strand"], r["read"], r["position"]) for r in analyses.mbias(reads, reference, PileupOptions(contexts=ALL)).collect()}
    assert {(r["strand"], r["read"], r["position"]) for r in cut} == {(s, n, p) for s, n, p in every if not (n == 1 and (s == "OT" and not 3 <= p <= 6 or s == "OB" and p <= 2))}
    assert parse_bounds("1,2,3,4") == (1, 2, 3, 4)
    for bad in ("1,2,3", "1,2,3,x", "1,2,3,-4"):
        with pytest.raises(ValueError):
            parse_bounds(bad)
    with pytest.raises(ValueError):
        Trimming({"OT": (5, 4, 0, 0)})
    for bad in ({"contexts": ()}, {"minimum_base_quality": 0}, {"minimum_conversion_efficiency": float("nan")}):
        with pytest.raises(ValueError):
            PileupOptions(**bad)


def test_flags_of_the_read_filter(spark):
    rows = [(0, 60, None), (4, 60, None), (0, 9, None), (256, 60, None), (1024, 60, None), (9, 60, None), (1, 60, None), (3, 60, None), (0, 60, "i:2")]
    df = spark.createDataFrame(rows, "flag int, mapq int, nh string")
    count = lambda **o: df.where(ReadFilter(**o).passes()).count()
    assert (count(), count(keep_duplicates=True), count(keep_singletons=True, keep_discordant=True), count(ignore_nh=True), count(require_flags=2)) == (2, 3, 4, 3, 1)
    assert df.where(ReadFilter.per_read().passes()).count() == 6 and df.where(ReadFilter.per_read(ignore_flags=1024).passes()).count() == 5
    for bad in ("i:-1", "Z:x", "f:1.5"):
        with pytest.raises(Exception, match="NH must"):
            spark.createDataFrame([(0, 60, bad)], df.schema).where(ReadFilter().passes()).collect()


def test_reference_checks(spark, tmp_path, loaded):
    _, contigs, _, _ = loaded
    (tmp_path / "twice.fa").write_text(">a\nAC\n>a\nGT\n")
    with pytest.raises(ValueError, match="duplicate"):
        read_fasta(spark, str(tmp_path / "twice.fa"))
    (tmp_path / "short.fa").write_text(">zeta\nACGT\n>alpha\nAC\n")
    with pytest.raises(ValueError, match="zeta: length 4"):
        check_reference(read_fasta(spark, str(tmp_path / "short.fa")), contigs)


def bgzf(data: bytes, size: int) -> bytes:
    out = b""
    for i in range(0, len(data) + size, size):
        part = data[i : i + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam(reads: list[dict], long_cigar: bool = False) -> bytes:
    names = list(samples.CONTIGS)
    out = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(names))
    for n in names:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", len(samples.CONTIGS[n]))
    for r in reads:
        ops, n = [], ""
        for c in r["cigar"]:
            if c.isdigit():
                n += c
            else:
                ops.append(int(n) << 4 | "MIDNSHP=X".index(c))
                n = ""
        tags = (b"XGZ" + r["xg"].encode() + b"\0" if r["xg"] else b"") + (b"NHC" + bytes([r["nh"]]) if r["nh"] is not None else b"")
        if long_cigar:
            tags += b"CGBI" + struct.pack(f"<I{len(ops)}I", len(ops), *ops)
            ops = [len(r["bases"]) << 4 | 4, 9 << 4 | 3]
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in r["bases"]] + [0]
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(r["bases"]), 2))
        body = struct.pack("<iiBBHHHiiii", r["rid"], r["start"], len(r["name"]) + 1, r["mapq"], 0, len(ops), r["flag"], len(r["bases"]), -1, -1, 0)
        body += r["name"].encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(r["quals"]) + tags
        out += struct.pack("<i", len(body)) + body
    return out


@pytest.mark.parametrize("long_cigar", [False, True])
def test_bam_reads_as_sam(spark, files, loaded, long_cigar):
    at, rows = files
    path = at / f"reads{long_cigar}.bam"
    path.write_bytes(bgzf(bam(rows, long_cigar), 700))
    got, contigs = read_bam(spark, str(path))
    assert [tuple(r) for r in contigs.collect()] == [(i, n, len(s)) for i, (n, s) in enumerate(samples.CONTIGS.items())]
    drop = lambda df: [tuple(r)[1:] for r in df.orderBy("ord").collect()]
    assert drop(got) == drop(loaded[0])
    names = lambda reader: [n for p in reader.partitions() for b in reader.read(p) for n in b.column("name").to_pylist()]
    for split in (150, 700, 5000, 1 << 20):  # boundaries within records, blocks and the header
        reader = BamReader({"path": str(path), "splitBytes": str(split)})
        assert names(reader) == [r["name"] for r in rows]
        assert len(reader.partitions()) > 1 or split > 5000


def test_bam_index_reads_what_a_region_needs(spark, files, loaded, tmp_path):
    _, rows = files
    rows = sorted(rows, key=lambda r: (r["rid"], r["start"]))
    path = tmp_path / "reads.bam"
    path.write_bytes(bgzf(bam(rows), 400))
    plain = BamReader({"path": str(path)})
    offsets = [x for b in plain.read(plain.partitions()[0]) for x in b.column("ord").to_pylist()]
    assert offsets == sorted(set(offsets)) and len(offsets) == len(rows)
    out, ends = b"BAI\x01" + struct.pack("<i", 2), [*offsets[1:], path.stat().st_size << 16]
    for rid in (0, 1):
        own = [i for i, r in enumerate(rows) if r["rid"] == rid]
        chunks = [(offsets[i], ends[i]) for i in own[::5]] + [(offsets[own[0]], ends[own[-1]])]
        out += struct.pack("<i", 2) + struct.pack("<Ii", 4681, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        out += struct.pack("<Ii", 37450, 2) + struct.pack("<QQQQ", 0, 0, len(own), 0) + struct.pack("<iQ", 1, offsets[own[0]])
    (tmp_path / "reads.bam.bai").write_bytes(out)
    indexed = BamReader({"path": str(path), "splitBytes": "200"})
    parts = indexed.partitions()
    assert len(parts) > 3 and [n for p in parts for b in indexed.read(p) for n in b.column("name").to_pylist()] == [r["name"] for r in rows]
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    pushed = [EqualTo(("rid",), 1), GreaterThanOrEqual(("start",), 3), LessThan(("start",), 12)]
    assert list(indexed.pushFilters(pushed)) == pushed
    assert indexed.partitions()[0].begin == offsets[[r["rid"] for r in rows].index(1)]
    got = [n for p in indexed.partitions() for b in indexed.read(p) for n in b.column("name").to_pylist()]
    assert got == [r["name"] for r in rows if r["rid"] == 1 and 3 <= r["start"] <= 12]
    reads, _ = read_bam(spark, str(path))
    found = reads.where("rid = 1 and start >= 3 and start < 12").orderBy("ord").collect()
    assert [r["name"] for r in found] == [r["name"] for r in rows if r["rid"] == 1 and 3 <= r["start"] < 12]


def test_command_line(spark, files, tmp_path):
    at, rows = files
    inputs = [str(at / "ref.fa"), str(at / "reads.sam")]
    want = samples.model(rows)
    names = list(samples.CONTIGS)
    prefix = str(tmp_path / "out")
    told = cli.main(["extract", *inputs, "-o", prefix, "--chg", "--format", "counts"], spark)
    lines = (tmp_path / "out_CpG.counts.bedGraph").read_text().split("\n")
    assert lines[0] == f'track type="bedGraph" description="{prefix} CpG methylation counts"'
    assert lines[1:-1] == [f"{names[r]}\t{p}\t{p + 1}\t{v['m'] + v['u']}" for (r, p), v in sorted(want.items()) if v["ctx"] == "CG" and v["m"] + v["u"]]
    assert told["input_records"] == len(rows) and told["filtered_records"] == sum(not samples.passes(r) for r in rows)
    told = cli.main(["extract", *inputs, "-o", prefix, "--cytosine_report", "--chg", "--chh"], spark)
    assert told["output_records"] == len((tmp_path / "out.cytosine_report.txt").read_text().splitlines()) == sum(c in "CG" for s in samples.CONTIGS.values() for c in s)
    told = cli.main(["mbias", *inputs, "-o", str(tmp_path / "bias")], spark)
    assert (tmp_path / "bias_mbias.tsv").read_text().startswith("Strand\tRead\tPosition\tnMethylated\tnUnmethylated\nOT\t")
    assert len(told["outputs"]) == 1 + len(told["suggestions"]) and "polyline" in (tmp_path / "bias_OT.svg").read_text()
    told = cli.main(["per-read", *inputs, "-o", str(tmp_path / "reads.tsv")], spark)
    assert "\t0.0\t0\n" in (tmp_path / "reads.tsv").read_text() and told["output_records"] + told["filtered_records"] == len(rows)
    # failures leave old files as they were
    before = (tmp_path / "out_CpG.counts.bedGraph").read_bytes()
    for bad in (["-r", "nowhere"], ["--no-cpg"], ["--merge-context", "--format", "methylkit"], ["--keepStrand"], ["-p", "0"]):
        with pytest.raises(ValueError):
            cli.main(["extract", *inputs, "-o", prefix, *(["--format", "counts"] if "--format" not in bad else []), *bad], spark)
    assert (tmp_path / "out_CpG.counts.bedGraph").read_bytes() == before and not [f for f in os.listdir(tmp_path) if f.startswith(".")]


def test_options_of_the_command_line(spark, files, tmp_path, capsys, monkeypatch):
    at, rows = files
    inputs = [str(at / "ref.fa"), str(at / "reads.sam")]
    for bad in (["-q", "256"], ["-q", "-1"], ["-p", "300"], ["-F", "0x10000"], ["-R", "-2"], ["-d", "-1"], ["--minOppositeDepth", "x"], ["--format", "other"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(["extract", *inputs, "-o", "x", *bad])
    args = cli.parser().parse_args(["extract", *inputs, "-o", "x", "--format", "methyl-kit", "-F", "0x400", "-d", "010"])
    assert (args.format, args.ignore_flags, args.minimum_depth) == ("methylkit", 0x400, 10)
    told = cli.main(["extract", *inputs, "-o", str(tmp_path / "kit"), "--format", "methyl-kit"], spark)
    lines = (tmp_path / "kit_CpG.methylKit").read_text().splitlines()
    assert lines[0].startswith("chrBase\t") and len(lines) == 1 + told["output_records"] and told["examined_columns"] >= told["output_records"]
    # variants, report and intervals together
    bed = tmp_path / "some.bed"
    bed.write_text("zeta\t10\t40\tx\t0\t+\n")
    more = ["--minOppositeDepth", "1", "--maxVariantFrac", "0.4", "--chg", "--chh", "-l", str(bed), "--keepStrand"]
    told = cli.main(["extract", *inputs, "-o", str(tmp_path / "both"), "--cytosine_report", *more], spark)
    want, seq = samples.model(rows), samples.CONTIGS["zeta"]
    out = {k for k, v in want.items() if v["opposite"] >= 1 and v["variant"] / v["opposite"] > 0.4}
    inside = [i for i in range(10, 40) if seq[i] == "C"]
    # bases of reads on the other strand lie outside of the intervals, so nothing is excluded
    got = [line.split("\t") for line in (tmp_path / "both.cytosine_report.txt").read_text().splitlines()]
    assert [int(g[1]) - 1 for g in got] == inside and told["excluded_variant_sites"] == 0 and out
    assert all((int(g[3]), int(g[4])) == tuple(want.get((0, int(g[1]) - 1), {"m": 0, "u": 0})[k] for k in "mu") for g in got)
    told = cli.main(["mbias", *inputs, "-o", str(tmp_path / "bias")], spark)
    rows_ = [line.split("\t") for line in (tmp_path / "bias_mbias.tsv").read_text().splitlines()[1:]]
    assert told["calls"] == sum(int(x[3]) + int(x[4]) for x in rows_) > 0
    # a table from standard input
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(f"zeta\t1\t2\t50\t1\t1\nzeta\t2\t3\t0\t0\t2\n".encode())))
    told = cli.main(["merge-context", inputs[0], "-"], spark)
    assert capsys.readouterr().out.splitlines()[1:] == ["zeta\t1\t3\t25\t1\t3"] and told["merged_records"] == 1


def test_standalone_merge(spark, files, tmp_path):
    at, _ = files
    # zeta: ACGTCAGC...: CpG at 1-2, CHG at 4-6
    (tmp_path / "in.bedGraph").write_text('track type="bedGraph"\nzeta\t1\t2\t50\t1\t1\nzeta\t2\t3\t66\t2\t1\nzeta\t4\t5\t100\t4\t0\nalpha\t0\t1\t0\t0\t7\n')
    cli.main(["merge-context", str(at / "ref.fa"), str(tmp_path / "in.bedGraph"), "-o", str(tmp_path / "out")], spark)
    assert (tmp_path / "out").read_text() == 'track type="bedGraph" description="merged Methylation metrics"\nzeta\t1\t3\t60\t3\t2\nzeta\t4\t7\t100\t4\t0\nalpha\t0\t2\t0\t0\t7\n'
    for bad in ("zeta\t1\t2\t50\t0\t0", "zeta\t1\t3\t50\t1\t1", "zeta\t1\t2\t101\t1\t1", "zeta\t 1\t2\t50\t1\t1", "zeta\t1\t2\t50\t1", "zeta\t2\t3\t50\t1\t1\nzeta\t1\t2\t50\t1\t1", "zeta\t0\t1\t50\t1\t1"):
        (tmp_path / "bad").write_text(bad + "\n")
        with pytest.raises(Exception):
            cli.main(["merge-context", str(at / "ref.fa"), str(tmp_path / "bad"), "-o", str(tmp_path / "out")], spark)
    (tmp_path / "again").write_text("zeta\t1\t2\t50\t1\t1\nalpha\t0\t1\t50\t1\t1\nzeta\t2\t3\t50\t1\t1\n")
    with pytest.raises(ValueError, match="again"):
        check_chromosome_order(read_metrics(spark, str(tmp_path / "again")), "again")


def test_outputs_are_all_or_nothing(tmp_path, monkeypatch):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("old\n")
    with Outputs() as out:
        out.write(str(a), ["new"])
        out.write(str(b), ["new"])
        real = os.replace
        monkeypatch.setattr(os, "replace", lambda x, y: (_ for _ in ()).throw(OSError("full")) if y == str(b) else real(x, y))
        with pytest.raises(OSError):
            out.commit()
    assert a.read_text() == "old\n" and sorted(os.listdir(tmp_path)) == ["a"]
    with pytest.raises(ValueError, match="input"):
        Outputs([str(a)]).check(str(a))
    with pytest.raises(ValueError, match="regular"):
        Outputs().check(str(tmp_path))


def test_stream_gives_the_batch_histogram(spark, files, loaded, tmp_path):
    at, _ = files
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text((at / "reads.sam").read_text())
    known = [tuple(r) for r in loaded[1].collect()]
    loaded[2].write.parquet(str(tmp_path / "reference"))
    query = stream_mbias(stream_sam(spark, str(tmp_path / "in"), known), spark.read.parquet(str(tmp_path / "reference"))).writeStream.outputMode("complete").format("memory").queryName("bias").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("bias").collect()} == {tuple(r) for r in analyses.mbias(loaded[0], loaded[2]).collect()}


@pytest.mark.parametrize("name", ["extract_cpg", "extract_zero_depth", "extract_bed_stranded", "variant_exclusion", "merge_context_extract", "cytosine_report_bed", "conversion_filter", "mbias_suggestion", "per_read_bed", "run_stats"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = testdata.queries()[name](spark, SF)
    names = sorted(got.columns)
    rel = con.sql(testdata.oracle_sql()[name])
    want = sorted(rel.select(*names).fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want and want


def test_counted_trinucleotides_agree_with_sql_and_walk_no_strings(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = testdata.queries()["trinucleotide"](spark, SF)
    want = con.sql(testdata.oracle_sql()["trinucleotide"]).select(*got.columns).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    # own bases are told in bytes, before anything is made of their neighbours
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "= 0x43" in plan and "= 0x47" in plan


def test_bed_report_counts_only_what_reads_cover(spark):
    assert "Union" not in testdata.queries()["cytosine_report_bed"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
