"""Packing of tokenised documents into sequences of a fixed size: dominance reduction, then best fit.

Only the lengths of pieces matter, and there are at most as many lengths as a sequence has tokens. So the plan is made
from the counts by length: the reduction fixes sets of up to three pieces that are part of some optimal packing, and best
fit decreasing packs the remainder, many equal sequences at a time. The plan's size depends on the sequence size, not on
the corpus. The pieces then take the places of the plan by their rank among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrowed, columns, settled, slices, with_fields

#: Chunks that a worker remembers at most: half of them are the latest new ones, as each worker keeps them from task to task.
CHUNKS = 240_000
#: Pieces of one length that are ranked in one group.
RANKED = 500


class WordTokenizer:
    """The ids of a tokenizer that drops white space, by chunks between white space, which never share a token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # when the first is full, it takes the place of the second, from which chunks that are met again come back
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # the bytes of each id, once
        self.bytes_of = [int(i).to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values()))]
        # Texts with other characters may be changed by normalisation, or have white space that Python sees and Unicode doesn't
        self.plain = re.compile("[^\x00-\x1b\x20-įı-ɏ]")
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}

    def chunk(self, text: str) -> bytes:
        """The ids of a chunk that isn't among the known ones, which it joins if it is short."""
        out = self.older.get(text)
        if out is None:
            out = self.told(text)
        if len(text) <= 64:
            if len(self.known) >= CHUNKS // 2:
                self.known, self.older = {}, self.known
            self.known[text] = out
        return out

    def told(self, text: str) -> bytes:
        parts = (text,) if text.isascii() and text.isalpha() else self.parts.findall(text)
        model, ids = self.tokenizer.model, []
        for part in parts:
            ids += [t.id for t in model.tokenize(part if part.isascii() and part.isprintable() else "".join(map(self.letters.__getitem__, part.encode())))]
        return b"".join([self.bytes_of[i] for i in ids])

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        lower = text.lower()
        # an added token's content is one id wherever it stands, which chunks don't show
        if self.plain.search(text) or any(t in lower for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunk = self.chunk
        # chunks may put another table in known's place
        return b"".join([self.known.get(c) or chunk(c) for c in lower.split()])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, end_id: int = 1, size: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece: a document's ids and end_id, cut every size tokens. A null
    text counts as empty and gives one piece, of end_id alone."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in slices(batches):
            out = []
            for d, t in columns(batch, "doc_id", text):
                data = tok.ids(t or "") + last
                for n, at in enumerate(range(0, len(data), 4 * size)):
                    cut = data[at : at + 4 * size]
                    out.append((d, n, at // 4, len(cut) // 4, zlib.crc32(cut)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrowed(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias(text)), run, schema)


def reduced(counts: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fixes sequences that dominate all other feasible ones with one of their pieces, and takes them out of counts (by
    length). A set dominates another if each of its pieces has room for a part of the other's, and these parts are all of it:
    what it takes away can then stand where they stood. For a piece j these sets dominate all sets with j:
    - {j}, if nothing fits beside it;
    - {j, k}, if k is the largest piece that fits and fills the room, or no two pieces fit there together;
    - {j, k, l}, if besides k the largest piece that still fits is l, no three pieces fit beside j, nor two that are both longer
      than l."""
    fixed: list[tuple[int, list[tuple[int, int]]]] = []

    def fix(*lengths: int) -> None:
        # fewer pieces are left after each such sequence, so what held for the first holds for all
        items = sorted(Counter(lengths).items(), reverse=True)
        n = min(int(counts[length]) // times for length, times in items)
        fixed.append((n, items))
        for length, times in items:
            counts[length] -= n * times

    def least(own: np.ndarray, start: int, n: int) -> int:
        """The sum of the n shortest pieces of a length of start or more; more than size if there are fewer."""
        total = 0
        for length in start + np.flatnonzero(own[start:]):
            take = min(n, int(own[length]))
            total, n = total + take * int(length), n - take
            if not n:
                return total
        return size + 1

    changed = True
    while changed:
        changed = False
        for j in range(size, 0, -1):
            if not counts[j]:
                continue
            room, own = size - j, counts.copy()
            own[j] -= 1
            there = np.flatnonzero(own[: room + 1])
            if not len(there):
                fix(j)
                changed = True
                continue
            k = int(there[-1])
            if k == room or least(own, 0, 2) > room:
                fix(j, k)
                changed = True
            elif least(own, 0, 3) > room:
                own[k] -= 1
                beside = np.flatnonzero(own[: room - k + 1])
                own[k] += 1
                if len(beside) and least(own, int(beside[-1]) + 1, 2) > room:
                    fix(j, k, int(beside[-1]))
                    changed = True
    return fixed


def best_fit(counts: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit decreasing of what counts has; equal sequences are kept as one entry with their number."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for length in range(size, 0, -1):
        n = int(counts[length])
        for room in sorted(r for r in open_ if r >= length):
            groups = open_.pop(room)
            while groups and n:
                bins, items = groups.pop()
                each = room // length
                full = min(bins, n // each)
                rest = n - full * each if full < bins else 0
                n -= full * each + rest
                for number, times in ((full, each), (1 if rest else 0, rest), (bins - full - (1 if rest else 0), 0)):
                    if number:
                        open_.setdefault(room - times * length, []).append((number, items + [(length, times)] * (times > 0)))
            if groups:
                open_.setdefault(room, []).extend(groups)
            if not n:
                break
        if n:
            each = size // length
            for number, times in ((n // each, each), (1 if n % each else 0, n % each)):
                if number:
                    open_.setdefault(size - times * length, []).append((number, [(length, times)]))
    return [g for groups in open_.values() for g in groups]


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Rows (length, first rank, places in each sequence, first sequence, offset), sorted: the places of each length's
    pieces by their rank."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    groups = reduced(left, size) + best_fit(left, size)
    ranks, rows, sequence = np.zeros(size + 1, np.int64), [], 0
    for bins, items in groups:
        at = 0
        for length, times in items:
            rows.append((length, int(ranks[length]), times, sequence, at))
            ranks[length] += bins * times
            at += length * times
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(found: DataFrame, size: int = 4096) -> DataFrame:
    """found (with doc_id, piece, ids_crc32 and length from 1 to size) with sequence_id and offset. Pieces of a sequence lie
    side by side from 0. An empty table gives an empty one. found must give the same rows each time it is read."""
    hist = found.groupBy("length").agg(F.count(F.lit(1)).alias("_n"))
    rows = plan({r["length"]: r["_n"] for r in hist.collect()}, size)  # size rows at most
    groups = F.ceil(F.col("_n") / F.lit(RANKED)).cast("long")
    split = found.join(F.broadcast(hist), "length").withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), groups)).drop("_n")
    before = (
        split.groupBy("length", "_g")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.sum("_c").over(Window.partitionBy("length").orderBy("_g")) - F.col("_c"))
        .drop("_c")
    )
    order = Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32")
    ranked = split.withColumn("_rank", F.row_number().over(order).cast("long") - 1).join(before, ["length", "_g"])
    ranked = ranked.select(*found.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    schema = with_fields(found, found.columns, "sequence_id long, offset long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            row = rows[np.searchsorted(starts, (length << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_rank"]
            arrays = [batch.column(i) for i in keep] + [pa.array(row[:, 3] + nth // np.maximum(row[:, 2], 1)), pa.array(row[:, 4] + nth % np.maximum(row[:, 2], 1) * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    return arrowed(ranked, place, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, size: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts and packs all documents; see pieces() and pack(). Repeated rows are packed each."""
    return pack(settled(pieces(docs, path, end_id, size, doc_id, text)), size)
