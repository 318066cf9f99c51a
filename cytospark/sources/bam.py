"""BAM files as a Spark data source: spark.read.format("bam").load(path).

A partition is a range of the compressed file. With an index beside the file (.bai or .csi) partitions begin at records that it names,
and a filter of the contig and the place (rid, start) reads only the part of the file that it needs. Without one, planning
looks at the header alone: each task finds the first block in its range and the first record in that, by checking that
several plausible records follow one another. Records that cross a boundary are read by the partition in which they begin.
A record's ord is its virtual offset (the block's place in the file, then the record's in the block). CRAM isn't
supported.

The option region ("rid:start-end", half open from 0) gives the records that overlap a region, which no filter of columns can say, as
a record's end is none. The index then names the bins that may hold such records; of their chunks, what ends before the first
record that reaches the region's window is cut off, and chunks that touch are read as one. Without an index the whole file
is read for it.
"""

from __future__ import annotations

import gzip
import os
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .sam import CONTIGS, READS

BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
MAGIC = b"\x1f\x8b\x08\x04"
#: Compressed bytes of a partition, records of an Arrow batch, and records that must follow one another for the first of them to be
#: taken for one.
SPLIT, BATCH, CHAIN = 64 << 20, 2048, 6
END = 1 << 63
_letters = str.maketrans("0123456789abcdef", BASES)
_phred = bytes(min(q + 33, 255) for q in range(256))


def block_size(head: bytes) -> int | None:
    """The bytes of the block that begins with head; null if none does."""
    if head[:4] != MAGIC or len(head) < 18:
        return None
    k, stop = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while k + 6 <= min(stop, len(head)):
        if head[k : k + 4] == b"BC\x02\0":
            return struct.unpack_from("<H", head, k + 4)[0] + 1
        k += 4 + struct.unpack_from("<H", head, k + 2)[0]
    return None


class Stream:
    """The contents of the blocks from an offset on, with the virtual offset of the place in them."""

    def __init__(self, path: str, offset: int = 0):
        self.path, self.file, self.offset = path, open(path, "rb"), offset
        self.data, self.at, self.starts = b"", 0, [(0, offset)]  # starts: (place in data, file offset) of the blocks held
        self.pin: int | None = None  # a place from which on data is held, too
        self.taken = 0  # compressed bytes that were read

    def __enter__(self) -> Stream:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def seek_block(self) -> bool:
        """Goes on to the first block from the offset on; whether there is one."""
        self.file.seek(self.offset)
        window = self.file.read(1 << 17)  # a block has 64 KB at most
        at = window.find(MAGIC)
        while at >= 0:
            size = block_size(window[at : at + 512])
            if size and (window[at + size : at + size + 4] == MAGIC or self.offset + at + size == os.fstat(self.file.fileno()).st_size):
                self.offset += at
                self.data, self.at, self.starts = b"", 0, [(0, self.offset)]
                return True
            at = window.find(MAGIC, at + 1)
        return False

    def fill(self, n: int) -> bool:
        """Whether n bytes are there from the place on."""
        while len(self.data) - self.at < n:
            self.file.seek(self.offset)
            head = self.file.read(512)
            if not head:
                return False
            size = block_size(head)
            if size is None:
                raise ValueError(f"{self.path}: no block at {self.offset}")
            self.file.seek(self.offset)
            body = self.file.read(size)
            if len(body) < size:
                raise ValueError(f"{self.path}: cut off")
            more = zlib.decompress(body[12 + struct.unpack_from("<H", body, 10)[0] : -8], -15)
            held = self.at if self.pin is None else min(self.at, self.pin)
            keep = max(p for p, _ in self.starts if p <= held)
            self.data = self.data[keep:] + more
            self.starts = [(p - keep, o) for p, o in self.starts if p >= keep] + [(len(self.data), self.offset + size)]
            self.at, self.offset, self.taken = self.at - keep, self.offset + size, self.taken + size
            self.pin = None if self.pin is None else self.pin - keep
        return True

    def read(self, n: int) -> bytes:
        self.fill(n)
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out

    def virtual(self) -> int:
        """The virtual offset of the place; the one in the next block at a block's end."""
        place, offset = max((p, o) for p, o in self.starts if p <= self.at)
        return offset << 16 | self.at - place


def contigs(stream: Stream) -> list[tuple[str, int]]:
    """Reads the header."""
    if stream.read(4) != b"BAM\x01":
        raise ValueError("no BAM header")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        n = struct.unpack("<i", stream.read(4))[0]
        name = stream.read(n)[:-1].decode()
        out.append((name, struct.unpack("<i", stream.read(4))[0]))
    return out


def plausible(stream: Stream, at: int, lengths: list[int]) -> int | None:
    """The place after what may be a record at a place of the stream's data; null if it can't be one."""
    stream.at = at
    if not stream.fill(36):
        return None
    at = stream.at
    size, rid, start, n_name, _, _, n_cigar, _, n_bases, other, place, _ = struct.unpack_from("<iiiBBHHHiiii", stream.data, at)
    if not -1 <= rid < len(lengths) or not -1 <= other < len(lengths) or n_name < 1 or n_bases < 0 or place < -1:
        return None
    if start < -1 or rid >= 0 and start > lengths[rid] or size < 32 + n_name + 4 * n_cigar + (n_bases + 1) // 2 + n_bases:
        return None
    if not stream.fill(36 + n_name + 4 * n_cigar):
        return None
    at = stream.at
    name = stream.data[at + 36 : at + 36 + n_name]
    if name[-1] or any(not 33 <= c <= 126 for c in name[:-1]):
        return None
    if any(op & 15 > 8 for op in struct.unpack_from(f"<{n_cigar}I", stream.data, at + 36 + n_name)):
        return None
    return size + 4


def first_record(stream: Stream, lengths: list[int]) -> bool:
    """Goes on to the first place from which CHAIN plausible records follow, or as many as the file has; whether there is one. What has
    been inflated is held meanwhile, so every block is inflated once."""
    stream.pin = stream.at
    try:
        while stream.fill(1):
            n = 0
            while n < CHAIN and stream.fill(1):
                size = plausible(stream, stream.at, lengths)
                if size is None or not stream.fill(size):
                    n = -1
                    break
                stream.at += size
                n += 1
            stream.at = stream.pin
            if n > 0:
                return True
            stream.at = stream.pin = stream.pin + 1
        return False
    finally:
        stream.pin = None


def tags(data: bytes) -> dict[str, tuple[str, object]]:
    """Type and value of each tag; arrays as tuples."""
    sizes = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    out, at = {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in sizes:
            out[name] = (kind, struct.unpack_from("<" + sizes[kind], data, at)[0])
            at += struct.calcsize(sizes[kind])
        elif kind == "A":
            out[name] = (kind, chr(data[at]))
            at += 1
        elif kind in "ZH":
            end = data.index(0, at)
            out[name] = (kind, data[at:end].decode())
            at = end + 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            out[name] = (kind, struct.unpack_from(f"<{n}{sizes[of]}", data, at + 5))
            at += 5 + n * struct.calcsize(sizes[of])
        else:
            raise ValueError(f"unknown tag type {kind}")
    return out


def record(data: bytes, number: int, names: list[str]) -> tuple:
    """A read as in READS. A CIGAR that is too long for its field stands in the tag CG."""
    rid, start, n_name, mapq, _, n_cigar, flag, n_bases = struct.unpack_from("<iiBBHHHi", data)
    at = 32 + n_name
    name = data[32 : at - 1].decode()
    cigar = struct.unpack_from(f"<{n_cigar}I", data, at)
    at += 4 * n_cigar
    bases = data[at : at + (n_bases + 1) // 2].hex().translate(_letters)[:n_bases]
    at += (n_bases + 1) // 2
    quals = data[at : at + n_bases]
    found = tags(data[at + n_bases :])
    if n_cigar == 2 and "CG" in found and cigar[0] & 15 == 4 and cigar[0] >> 4 == n_bases and cigar[1] & 15 == 3:
        cigar = found["CG"][1]
    xg, nh = found.get("XG"), found.get("NH")
    return (
        number,
        name,
        flag,
        rid,
        names[rid] if rid >= 0 else "*",
        start,
        mapq,
        "".join(f"{c >> 4}{OPS[c & 15]}" for c in cigar) or "*",
        bases or "*",
        "*" if not quals or quals[0] == 255 else quals.translate(_phred).decode("latin-1"),
        str(xg[1]) if xg else None,
        ("i" if nh[0] in "cCsSiI" else nh[0]) + f":{nh[1]}" if nh else None,
    )


class Index:
    """A contig's part of an index: bins (number to ranges of virtual offsets), and for places the offset of the first record that reaches
    into their surroundings or beyond: linear has one for each 16 kb, firsts one for bins. Leaves of the tree of bins are 2 to
    the shift places wide, and depth levels up is the root."""

    def __init__(self, bins: dict[int, list[tuple[int, int]]], linear: list[int] = (), firsts: dict[int, int] | None = None, shift: int = 14, depth: int = 5):
        self.bins, self.linear, self.firsts, self.shift, self.depth = bins, linear, firsts or {}, shift, depth

    def ranges(self) -> list[tuple[int, int]]:
        """The ranges of all records, in order."""
        return sorted(r for chunks in self.bins.values() for r in chunks)

    def least(self, start: int) -> int:
        """An offset before which no record reaches start."""
        if self.linear:
            return self.linear[min(start >> 14, len(self.linear) - 1)]
        leaf = list(bins_of(start, start + 1, self.shift, self.depth))[-1]
        while leaf not in self.firsts and leaf:
            leaf = leaf - 1 >> 3
        return self.firsts.get(leaf, 0)

    def chunks(self, start: int, end: int) -> list[tuple[int, int]]:
        """Ranges with all records that overlap start to end: those of the bins that may hold some, without what ends before the
        first record that reaches start; ranges that meet within a block are one."""
        least = self.least(start)
        out: list[tuple[int, int]] = []
        for a, b in sorted(r for k in bins_of(start, end, self.shift, self.depth) for r in self.bins.get(k, ())):
            if b <= least:
                continue
            a = max(a, least)
            if out and a >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


def first_bin(level: int) -> int:
    """The number of the first bin of a level; each bin has eight in the level below."""
    return ((1 << 3 * level) - 1) // 7


def bins_of(start: int, end: int, shift: int = 14, depth: int = 5) -> Iterator[int]:
    """The bins that a record overlapping start to end may be in: those of every level, from the root down."""
    for level in range(depth + 1):
        wide = shift + 3 * (depth - level)
        yield from range(first_bin(level) + (start >> wide), first_bin(level) + (max(end, start + 1) - 1 >> wide) + 1)


def index_of(path: str) -> list[Index] | None:
    """The index of each contig (.bai or .csi); null without one."""
    named = (f"{x}.{kind}" for kind in ("bai", "csi") for x in (path, path.removesuffix(".bam")))
    at = next((x for x in named if os.path.exists(x)), None)
    if not at:
        return None
    with open(at, "rb") as f:
        data = f.read()
    data = gzip.decompress(data) if data[:2] == MAGIC[:2] else data
    place, out = 4, []

    def take(kind: str) -> tuple:
        nonlocal place
        place += struct.calcsize(kind)
        return struct.unpack_from(kind, data, place - struct.calcsize(kind))

    shift, depth, own = 14, 5, data[:4] == b"CSI\x01"
    if own:
        shift, depth, more = take("<iii")
        place += more
    elif data[:4] != b"BAI\x01":
        raise ValueError(f"{at}: no index")
    for _ in range(take("<i")[0]):
        bins: dict[int, list[tuple[int, int]]] = {}
        firsts: dict[int, int] = {}
        for _ in range(take("<i")[0]):
            number = take("<I")[0]
            first = take("<Q")[0] if own else 0
            chunks = [take("<QQ") for _ in range(take("<i")[0])]
            if number <= first_bin(depth + 1):  # the one after that stands for counts
                bins.setdefault(number, []).extend(chunks)
                if own:
                    firsts[number] = first
        linear = [] if own else list(take(f"<{take('<i')[0]}Q"))
        out.append(Index(bins, linear, firsts, shift, depth))
    return out


def reach(data: bytes) -> tuple[int, int, int]:
    """rid, start and end of a record; one that covers no reference counts as covering a place."""
    rid, start, n_name, _, _, n_cigar, _, n_bases = struct.unpack_from("<iiBBHHHi", data)
    cigar = struct.unpack_from(f"<{n_cigar}I", data, 32 + n_name)
    if n_cigar == 2 and cigar[0] & 15 == 4 and cigar[0] >> 4 == n_bases and cigar[1] & 15 == 3:
        return rid, start, start + max(cigar[1] >> 4, 1)  # the whole one stands in a tag
    return rid, start, start + max(sum(c >> 4 for c in cigar if c & 15 in (0, 2, 3, 7, 8)), 1)


def parse_region(text: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"(\d+):(\d+)-(\d+)", text)
    if not m or int(m[2]) >= int(m[3]):
        raise ValueError(f"a region is rid:start-end, not {text}")
    return int(m[1]), int(m[2]), int(m[3])


class Range(InputPartition):
    """Records that begin from one virtual offset on and before another; known: whether one begins at the first."""

    def __init__(self, begin: int, end: int, known: bool):
        self.begin, self.end, self.known = begin, end, known


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.split = int(options.get("splitBytes", SPLIT))
        self.rid, self.least, self.most = None, None, None
        self.region = parse_region(options["region"]) if "region" in options else None
        self.taken = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes note of the contig and the range of starts; Spark still applies all filters."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("rid",):
                self.rid = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("start",):
                self.least = max(f.value, self.least if self.least is not None else f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("start",):
                self.most = min(f.value, self.most if self.most is not None else f.value)
            yield f

    def partitions(self) -> list[Range]:
        """Ranges of SPLIT compressed bytes. The header and the index are all that is read."""
        with Stream(self.path) as stream:
            contigs(stream)
            if not stream.fill(1):
                return []
            first = stream.virtual()
        index = index_of(self.path)
        if index is None:
            cuts = [o << 16 for o in range(0, os.path.getsize(self.path), self.split) if o << 16 > first]
            edges = [first, *cuts, END]
            return [Range(a, b, a == first) for a, b in zip(edges, edges[1:])]
        if self.region:
            rid, start, stop = self.region
            return self.dealt(index[rid], index[rid].chunks(start, stop)) if rid < len(index) else []
        begin, end, parts = first, END, index
        if self.rid is not None:
            own = index[self.rid] if 0 <= self.rid < len(index) else Index({}, [])
            ranges = own.ranges()
            if 0 <= self.rid and not ranges:
                return []
            if ranges:
                begin, end, parts = ranges[0][0], max(b for _, b in ranges), [own]
                if self.least is not None and self.least >> 14 < len(own.linear):
                    begin = max(begin, own.linear[max(self.least, 0) >> 14])
        edges = [begin]
        for cut in sorted({a for x in parts for a in (*(r[0] for r in x.ranges()), *x.linear)}):
            if begin < cut < end and (cut >> 16) - (edges[-1] >> 16) >= self.split:
                edges.append(cut)
        return [Range(a, b, True) for a, b in zip(edges, [*edges[1:], end])]

    def dealt(self, own: Index, chunks: list[tuple[int, int]]) -> list[Range]:
        """Chunks of split bytes at most, or nearly, cut at records that the index names."""
        out, cuts = [], sorted({*own.linear, *(a for a, _ in own.ranges())})
        for a, b in chunks:
            for cut in cuts[bisect_right(cuts, a) : bisect_left(cuts, b)]:
                if (cut >> 16) - (a >> 16) >= self.split:
                    out.append(Range(a, cut, True))
                    a = cut
            out.append(Range(a, b, True))
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with Stream(self.path) as stream:
            header = contigs(stream)
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        names, schema = [n for n, _ in header], pa.schema([(n, kinds[k]) for n, k in map(str.split, READS.split(", "))])
        sorted_ = index_of(self.path) is not None
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        with Stream(self.path, part.begin >> 16) as stream:
            if part.known:
                stream.read(part.begin & 0xFFFF)
            elif not stream.seek_block() or not first_record(stream, [n for _, n in header]):
                return
            while stream.fill(4) and (number := stream.virtual()) < part.end:
                data = stream.read(struct.unpack("<i", stream.read(4))[0])
                rid, start = struct.unpack_from("<ii", data)
                if self.region:
                    _, _, stop = reach(data)
                    if sorted_ and (rid, start) >= (self.region[0], self.region[2]):
                        break
                    if rid != self.region[0] or start >= self.region[2] or stop <= self.region[1]:
                        continue
                late = self.most is not None and start > self.most
                if sorted_ and self.rid is not None and rid == self.rid and late:
                    break
                if late or self.rid is not None and rid != self.rid or self.least is not None and start < self.least:
                    continue
                rows.append(record(data, number, names))
                if len(rows) >= BATCH:
                    yield batch()
                    rows.clear()
            self.taken += stream.taken
        if rows:
            yield batch()


class BamSource(DataSource):
    """Register with spark.dataSource.register(BamSource)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self):
        return READS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def bam_contigs(path: str) -> list[tuple[int, str, int]]:
    """rid, name and length of each contig of the header."""
    with Stream(path) as stream:
        return [(i, n, k) for i, (n, k) in enumerate(contigs(stream))]


def read_bam(spark, path: str, region: tuple[int, int, int] | None = None):
    """reads and contigs of a BAM file; with a region (rid, start, end), the reads that overlap it. Turns the session's setting on by
    which Spark tells Python sources of filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam")
    if region:
        reader = reader.option("region", "{}:{}-{}".format(*region))
    return reader.load(path), spark.createDataFrame(bam_contigs(path), CONTIGS)
