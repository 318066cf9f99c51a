"""Access by index, plans of the pile-up, coverage and metrics that arrive in order."""

import gzip
import os
import random
import struct

import pytest

from cytospark import cli
from cytospark.operators import coverage, evidence
from cytospark.operators.filters import ReadFilter
from cytospark.operators.selection import by_cells
from cytospark.plans import analyses
from cytospark.plans.options import ExtractOptions
from cytospark.sources import fai, fasta
from cytospark.sources.bam import BamReader, bins_of, first_bin, read_bam
from cytospark.sources.bed import merged
from cytospark.sources.fasta import read_fasta, reference_chunks
from cytospark.streaming.merge import END, stream_merge, stream_metrics

from . import samples
from .test_engine import ALL, bam, bgzf, files, loaded  # noqa: F401


def bai(records: list[tuple[int, int, int, int, int]], contigs: int) -> bytes:
    """An index of records (rid, start, stop, offset, end offset) in order."""
    out = b"BAI\x01" + struct.pack("<i", contigs)
    for rid in range(contigs):
        bins: dict[int, list[list[int]]] = {}
        linear: list[int] = []
        for r, start, stop, a, b in records:
            if r != rid:
                continue
            chunks = bins.setdefault(bin_of(start, stop, 14, 5), [])
            if chunks and chunks[-1][1] == a:
                chunks[-1][1] = b
            else:
                chunks.append([a, b])
            for w in range(start >> 14, (stop - 1 >> 14) + 1):
                while len(linear) <= w:
                    linear.append(0)
                linear[w] = linear[w] or a
        for w in range(len(linear) - 2, -1, -1):  # a window without records has the next one's
            linear[w] = linear[w] or linear[w + 1]
        out += struct.pack("<i", len(bins))
        for k, chunks in bins.items():
            out += struct.pack("<Ii", k, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        out += struct.pack("<i", len(linear)) + struct.pack(f"<{len(linear)}Q", *linear)
    return out


def bin_of(start: int, stop: int, shift: int, depth: int) -> int:
    """The smallest bin that a record lies in."""
    level, wide = depth, shift
    while start >> wide != stop - 1 >> wide:
        level, wide = level - 1, wide + 3
    return first_bin(level) + (start >> wide)


def csi(records: list[tuple[int, int, int, int, int]], contigs: int, shift: int, depth: int) -> bytes:
    """The same with bins of any size, and for each bin the first record that overlaps it."""
    out = b"CSI\x01" + struct.pack("<iii", shift, depth, 3) + b"xyz" + struct.pack("<i", contigs)
    for rid in range(contigs):
        bins: dict[int, list[tuple[int, int]]] = {}
        firsts: dict[int, int] = {}
        for r, start, stop, a, b in records:
            if r == rid:
                bins.setdefault(bin_of(start, stop, shift, depth), []).append((a, b))
                for k in bins_of(start, stop, shift, depth):
                    firsts.setdefault(k, a)
        counts = (first_bin(depth + 1) + 1, 0, [(0, 0), (len(records), 0)])
        out += struct.pack("<i", len(bins) + 1)
        for k, first, chunks in [*((k, firsts[k], c) for k, c in bins.items()), counts]:
            out += struct.pack("<IQi", k, first, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
    return gzip.compress(out)


@pytest.mark.parametrize("kind", ["bai", (14, 5), (12, 6), (16, 4)])
def test_region_of_an_indexed_bam(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(samples, "CONTIGS", {"big": "A" * 3_000_000, "small": "A" * 5_000})
    rng = random.Random(2)
    rows = []
    for k in range(3000):
        rid = int(k > 2900)
        n, skip = rng.randrange(20, 40), rng.choice([0, 0, 0, 50, 30_000, 900_000]) if not rid else 0
        length = n + 10 + skip if skip else n
        start = rng.randrange(0, len(list(samples.CONTIGS.values())[rid]) - length)
        cigar = f"{n}M{skip}N10M" if skip else f"{n}M"
        rows.append({"name": f"r{k}", "flag": 0, "rid": rid, "start": start, "stop": start + length, "mapq": 60, "cigar": cigar, "bases": "A" * (n + 10 * bool(skip)), "quals": [30] * (n + 10 * bool(skip)), "xg": "CT", "nh": 1})
    rows.sort(key=lambda r: (r["rid"], r["start"]))
    path = tmp_path / "reads.bam"
    path.write_bytes(bgzf(bam(rows), 2000))
    plain = BamReader({"path": str(path)})
    offsets = [x for b in plain.read(plain.partitions()[0]) for x in b.column("ord").to_pylist()]
    ends = [*offsets[1:], path.stat().st_size << 16]
    records = [(r["rid"], r["start"], r["stop"], a, b) for r, a, b in zip(rows, offsets, ends)]
    index = tmp_path / f"reads.bam.{'bai' if kind == 'bai' else 'csi'}"
    index.write_bytes(bai(records, 2) if kind == "bai" else csi(records, 2, *kind))
    for rid, start, end in [(0, 1_000_000, 1_020_000), (0, 0, 100), (0, 2_999_000, 3_000_000), (1, 100, 300), (0, 1_500_000, 1_500_001), (1, 4_990, 5_000)]:
        want = [r["name"] for r in rows if r["rid"] == rid and r["start"] < end and r["stop"] > start]
        for split in ("300", str(1 << 26)):
            reader = BamReader({"path": str(path), "region": f"{rid}:{start}-{end}", "splitBytes": split})
            got = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("name").to_pylist()]
            assert got == want
        # what begins far before the region and reaches over it lies in few blocks of its own
        wide = 0.75 if kind == (16, 4) else 0.6
        assert reader.taken < (wide if rid == 0 else 0.2) * path.stat().st_size
    reads, _ = read_bam(spark, str(path), (0, 1_000_000, 1_020_000))
    assert {r["name"] for r in reads.select("name").collect()} == {r["name"] for r in rows if r["rid"] == 0 and r["start"] < 1_020_000 and r["stop"] > 1_000_000}
    with pytest.raises(ValueError, match="region"):
        BamReader({"path": str(path), "region": "0:7-7"})
    assert [n for p in plain.partitions() for b in plain.read(p) for n in b.column("name").to_pylist()] == [r["name"] for r in rows]
    index.unlink()  # without an index the whole file is read for it
    reader = BamReader({"path": str(path), "region": "1:100-300"})
    assert [n for p in reader.partitions() for b in reader.read(p) for n in b.column("name").to_pylist()] == [r["name"] for r in rows if r["rid"] == 1 and r["start"] < 300 and r["stop"] > 100]


def index_text(text: str) -> str:
    out, at, name = [], 0, None
    for line in text.splitlines(keepends=True):
        at += len(line)
        if line.startswith(">"):
            out.append([line[1:].split()[0], 0, at, 0, 0])
        else:
            own = out[-1]
            own[1] += len(line.rstrip("\n"))
            own[3], own[4] = (own[3], own[4]) if own[3] else (len(line.rstrip("\n")), len(line))
    return "".join("\t".join(map(str, x)) + "\n" for x in out)


@pytest.mark.parametrize("chunk", [4, 16, 1 << 14])
def test_indexed_reference_is_the_reference(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(fasta, "CHUNK", chunk)
    path = tmp_path / "ref.fa"
    path.write_text(samples.fasta())
    (tmp_path / "ref.fa.fai").write_text(index_text(samples.fasta()))
    contigs = [(i, n, len(s)) for i, (n, s) in enumerate(samples.CONTIGS.items())]
    lines = reference_chunks(read_fasta(spark, str(path)), spark.createDataFrame(contigs, "rid int, chrom string, length long"))
    want = {tuple(r) for r in lines.select("rid", "chrom", "start", "seq", "left", "right").collect()}
    assert {tuple(r) for r in fai.indexed_chunks(spark, str(path), contigs).collect()} == want
    wanted = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 99)], "rid int, k long")
    assert {tuple(r) for r in fai.indexed_chunks(spark, str(path), contigs, wanted).collect()} == {r for r in want if (r[0], r[2] // chunk) in {(0, 0), (1, 1)}}


def test_index_checks(spark, tmp_path):
    path = tmp_path / "ref.fa"
    path.write_text(samples.fasta())
    own = index_text(samples.fasta())
    index = tmp_path / "ref.fa.fai"
    for text, said in ((own + own.splitlines()[0] + "\n", "duplicate reference zeta"), ("zeta\t5\n", "not a line"), ("zeta\t5\t6\t9\t3\n", "9 bases in 3 bytes")):
        index.write_text(text)
        with pytest.raises(ValueError, match=said):
            fai.read_index(str(path))
    index.write_text(own)
    known = fai.read_index(str(path))
    for contigs, said in (([(0, "zeta", 4)], "length 61, 4"), ([(0, "other", 4)], "missing")):
        with pytest.raises(ValueError, match=said):
            fai.check_index(known, contigs)
    path.write_text(samples.fasta().replace("\n", "\n\n", 3))
    with pytest.raises(Exception, match="doesn't fit"):
        fai.indexed_chunks(spark, str(path), [(i, n, len(s)) for i, (n, s) in enumerate(samples.CONTIGS.items())]).collect()


def test_a_region_reads_its_part_of_the_reference(spark, tmp_path, monkeypatch):
    """Of the reference's other parts the bytes are broken, and nobody notices."""
    rng = random.Random(9)
    seqs = {"one": "".join(rng.choice("ACGT") for _ in range(60_000)), "two": "".join(rng.choice("ACGT") for _ in range(40_000))}
    monkeypatch.setattr(samples, "CONTIGS", seqs)
    text = "".join(f">{n}\n" + "".join(s[i : i + 50] + "\n" for i in range(0, len(s), 50)) for n, s in seqs.items())
    (tmp_path / "ref.fa.fai").write_text(index_text(text))
    rows = [{"name": f"r{k}", "flag": 0, "rid": k % 2, "start": p, "mapq": 60, "cigar": "60M", "bases": "".join(rng.choice("CT") for _ in range(60)), "quals": [40] * 60, "xg": "CT", "nh": 1} for k, p in enumerate(rng.randrange(0, 39_000) for _ in range(400))]
    rows.sort(key=lambda r: (r["rid"], r["start"]))
    (tmp_path / "reads.sam").write_text(samples.sam(rows))
    run = lambda name, *more: cli.main(["extract", str(tmp_path / "ref.fa"), str(tmp_path / "reads.sam"), "-o", str(tmp_path / name), "--chh", *more], spark)
    (tmp_path / "ref.fa").write_text(text)
    run("whole")
    line, other = 50 + 1, len(">one\n") + 60_000 // 50 * 51
    broken = text[: 5 + 33_000 // 50 * line] + ">" * (other - 5 - 33_000 // 50 * line + 5) + text[other + 5 :]
    assert len(broken) == len(text)
    (tmp_path / "ref.fa").write_text(broken[: other + 5 + 33_000 // 50 * line] + "?" * (len(text) - other - 5 - 33_000 // 50 * line))
    told = run("part", "-r", "two:1001-2000")
    for ctx in ("CpG", "CHH"):
        full = [x for x in (tmp_path / f"whole_{ctx}.bedGraph").read_text().splitlines()[1:] if x.startswith("two\t") and 1000 <= int(x.split("\t")[1]) < 2000]
        assert (tmp_path / f"part_{ctx}.bedGraph").read_text().splitlines()[1:] == full and full
    near = [r for r in rows if r["rid"] == 1 and r["start"] < 2000 and r["start"] + 60 > 1000]
    assert told["input_records"] == len(near)
    assert told["examined_columns"] == len({p for r in near for p in range(r["start"], r["start"] + 60) if 1000 <= p < 2000})
    with pytest.raises(Exception, match="doesn't fit"):
        run("whole_again")


def test_pileup_has_one_exchange_of_pieces(spark, loaded):
    reads, _, reference, _ = loaded
    own = spark.createDataFrame(reference.collect(), reference.schema)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for exhaustive in (False, True):
            found = analyses.site_counts(reads, own, ExtractOptions(contexts=ALL), exhaustive=exhaustive)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan and plan.count("Exchange hashpartitioning(rid") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("options", [{}, {"minimum_depth": 0}, {"paired": False}])
def test_deep_cells_are_split(loaded, options):
    reads, _, reference, _ = loaded
    for exhaustive in (False, True):
        plain = analyses.site_counts(reads, reference, ExtractOptions(contexts=ALL, **options), exhaustive=exhaustive)
        split = analyses.site_counts(reads, reference, ExtractOptions(contexts=ALL, deep=7, **options), exhaustive=exhaustive)
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.collect()))
    with pytest.raises(ValueError):
        ExtractOptions(deep=0)


def test_intervals_by_cell(spark, loaded):
    reads, _, reference, rows = loaded
    bed = merged(spark.createDataFrame([(0, True, 5, 20), (0, False, 12, 30), (1, True, 0, 4), (1, True, 4, 9)], "rid int, top boolean, s long, e long"))
    assert {(r["rid"], r["cell"], len(r["on_top"]), len(r["on_bottom"])) for r in by_cells(bed).collect()} == {(0, 0, 1, 1), (1, 0, 1, 0)}
    options = ExtractOptions(contexts=ALL, minimum_opposite_depth=1, maximum_variant_fraction=0.9)
    inside = lambda rid, pos, top: any(a == rid and t == top and s <= pos < e for a, t, s, e in [(0, True, 5, 20), (0, False, 12, 30), (1, True, 0, 9)])
    every = {(r["rid"], r["pos"]): r for r in analyses.site_counts(reads, reference, options).collect()}
    got = {(r["rid"], r["pos"]): r for r in analyses.site_counts(reads, reference, options, bed).collect()}
    # a site outside of its own strand's intervals goes; one inside loses the other strand's bases where that has none
    assert set(got) <= {k for k, r in every.items() if inside(*k, r["fwd"])}
    for k, r in got.items():
        assert (r["m"], r["u"]) == (every[k]["m"], every[k]["u"])
        assert r["opposite"] == (every[k]["opposite"] if inside(*k, not r["fwd"]) else 0)
    assert {k for k, r in every.items() if r["m"] + r["u"] and inside(*k, r["fwd"])} <= set(got)


@pytest.mark.parametrize("bin_size", [3, 16, 1 << 14])
def test_examined_columns(loaded, monkeypatch, bin_size):
    monkeypatch.setattr(coverage, "BIN", bin_size)
    reads, _, _, rows = loaded
    spans = {"M": 1, "D": 1, "N": 1, "=": 1, "X": 1}

    def covered(r):
        n, p, out = "", r["start"], set()
        for c in r["cigar"]:
            if c.isdigit():
                n += c
            else:
                if c in spans:
                    out |= set(range(p, p + int(n)))
                    p += int(n)
                n = ""
        return out

    for region in (None, (0, 7, 31)):
        want = {}
        for r in rows:
            if samples.passes(r):
                want.setdefault(r["rid"], set()).update(p for p in covered(r) if not region or r["rid"] == 0 and 7 <= p < 31)
        found = coverage.examined_columns(evidence.aligned(reads.where(ReadFilter().passes())), region)
        assert {r["rid"]: r["n"] for r in found.collect()} == {k: len(v) for k, v in want.items() if v}


def test_metrics_that_arrive_in_order_settle(spark, loaded, tmp_path):
    reads, contigs, reference, _ = loaded
    sites = analyses.extract(reads, reference, ExtractOptions(contexts=ALL)).orderBy("rid", "pos").collect()
    metrics = spark.createDataFrame([(k, r["chrom"], r["pos"], r["m"], r["u"]) for k, r in enumerate(sites)], "ord long, chrom string, start long, methylated long, unmethylated long")
    want = {tuple(r) for r in analyses.merge_context(metrics, reference).select("chrom", "s", "e", "m", "u", "n").collect()}
    folder = tmp_path / "metrics"
    folder.mkdir()
    step = len(sites) // 6
    parts = [sites[i : i + step] for i in range(0, len(sites), step)]
    for k, part in enumerate([*parts, None]):
        lines = [f"{r['chrom']}\t{r['pos']}\t{r['pos'] + 1}\t0\t{r['m']}\t{r['u']}" for r in part] if part else [END]
        (folder / f"{k:03}.bedGraph").write_text("track type\n" * (k == 0) + "\n".join(lines) + "\n")
        os.utime(folder / f"{k:03}.bedGraph", (1000 + k, 1000 + k))
    own = spark.createDataFrame(reference.collect(), reference.schema)
    known = [tuple(r) for r in contigs.orderBy("rid").collect()]
    query = stream_merge(stream_metrics(spark, str(folder)), own, known).writeStream.format("memory").queryName("settled_spans").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    rows = [tuple(r) for r in spark.table("settled_spans").select("chrom", "s", "e", "m", "u", "n").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= step + 8 < len(want) and held[-1] <= 2  # a batch, and what may still grow
