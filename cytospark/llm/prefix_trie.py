"""The prefix trie of conversations, by an LCP-aware external mergesort.

A conversation is a path: a digest of 16 bytes for each turn. Tasks sort bounded runs of paths and note with each path how many
turns it shares with the one before it in its run (its LCP). Spark deals the runs to ranges of paths. Each range merges its
parts of the runs by a loser tree, in which paths meet by their LCPs with the last one that went out, so that shared turns are
never compared again. The LCP of each merged path says which nodes end: they are taken from a stack of the open path, with all
that their subtrees add up to.

A node whose conversations lie in several ranges is on the first or on the last path of each. Of these paths, each range sends on
one row for each node with what the range alone adds to it; one task puts them together in order, with the same kind of
stack. It reads two paths for each range, however many conversations they hold. So a prefix that a third of all
conversations begin with, or a path that a third of them have, is spread over as many ranges as it needs.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BATCH, WORD, arrowed, columns, settled, slices

#: Bytes of a turn's digest.
DIGEST = 16
#: Conversations and bytes of paths in a run at most (a longer path is a run of its own).
RUN_ROWS, RUN_BYTES = 8192, 8 << 20
#: Bytes of paths in a range, about; a conversation counts as ROW more.
RANGE, ROW = 4 << 20, 32

SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def turn_digest(role: Column, text: Column) -> Column:
    """A turn's digest: the first half of the SHA-256 of the role's length, a colon, role and text; null ones count as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, DIGEST)


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns (turn, digest, words), in order of turn (null first) and then of digest, of each conversation. Rows with a
    null conv_id belong to none; rows that repeat a turn are turns of their own. Texts don't move."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("int")
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), turn_digest(F.col(role), F.col(text)).alias("digest"), words.alias("words")).alias("t"))
    return rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """turns_of() in which each conversation c begins with the first h original turns of conversation c - c % group (all if there are
    fewer, none if it isn't there) in place of its own first h; h is the CRC-32 of the decimal c, modulo heads."""
    turns = settled(turns)
    none = F.slice("turns", 1, 0)
    first = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, max(heads - 1, 1)).alias("_first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = turns.withColumn("_h", h).join(first, F.col("conv_id") - F.col("conv_id") % group == F.col("_base"), "left")
    return own.select("conv_id", F.concat(F.slice(F.coalesce("_first", none), F.lit(1), F.col("_h")), F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def paths_of(turns: DataFrame) -> DataFrame:
    """conv_id, path (the turns' digests) and words (four bytes for each turn)."""
    joined = lambda f: F.unhex(F.array_join(F.transform("turns", f), ""))
    return turns.select("conv_id", joined(lambda t: F.hex(t["digest"])).alias("path"), joined(lambda t: F.lpad(F.hex(t["words"]), 8, "0")).alias("words"))


def shared_turns(one: bytes, two: bytes, known: int = 0) -> int:
    """How many turns two paths begin with in common; known of them are."""
    at, end = known * DIGEST, min(len(one), len(two))
    while at < end and one[at : at + DIGEST] == two[at : at + DIGEST]:
        at += DIGEST
    return at // DIGEST


def sorted_runs(paths: DataFrame) -> DataFrame:
    """paths with run, nth and lcp: in runs that are sorted by path and conv_id, each with the number of turns that it shares with
    the one before it in its run (0 for the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def done() -> pa.RecordBatch:
            rows.sort()
            lcp = [shared_turns(a[0], b[0]) for a, b in zip([(b"",), *rows], rows)]
            path, ids, words = zip(*rows) if rows else ((), (), ())
            arrays = [pa.array(ids, pa.int64()), pa.array(path, pa.binary()), pa.array(words, pa.binary()), pa.array([number] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(lcp, pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "path", "words", "run", "nth", "lcp"])

        for batch in slices(batches):
            for i, p, w in columns(batch, "conv_id", "path", "words"):
                if rows and (len(rows) >= RUN_ROWS or size + len(p) > RUN_BYTES):
                    yield done()
                    number, rows, size = number + 1, [], 0
                rows.append((p, i, w))
                size += len(p)
        yield done()

    return arrowed(paths, run, "conv_id long, path binary, words binary, run long, nth long, lcp int")


class LoserTree:
    """Merges runs of (path, conv_id, words, lcp), each sorted by path and conv_id, where lcp is the number of turns shared with the row
    before it in its run (0 for the first). Rows come out in order, with the number of turns shared with the row before.

    Every run's next path has a known LCP with the path that went out last. Of two, the one with the longer LCP is the smaller; only
    at equal LCPs are turns compared, from there on, and the loser then has a known LCP with the winner."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, bytes, int]]]):
        self.runs, k = runs, len(runs)
        self.row: list[tuple | None] = [None] * k
        self.lcp = [-1] * k  # of a run that has ended
        for i in range(k):
            self.step(i)
        winner = [0] * k + list(range(k))
        self.losers = [0] * k
        for node in range(k - 1, 0, -1):
            winner[node], self.losers[node] = self.play(winner[2 * node], winner[2 * node + 1])
        self.winner = winner[1] if k else -1

    def step(self, i: int) -> None:
        self.row[i] = next(self.runs[i], None)
        self.lcp[i] = self.row[i][3] if self.row[i] else -1

    def play(self, a: int, b: int) -> tuple[int, int]:
        """The run with the smaller row, then the other."""
        p, q = self.lcp[a], self.lcp[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        if p < 0:
            return a, b
        x, y = self.row[a], self.row[b]
        n = shared_turns(x[0], y[0], p)
        at = n * DIGEST
        if (x[0][at : at + DIGEST], x[1]) > (y[0][at : at + DIGEST], y[1]):
            a, b = b, a
        self.lcp[b] = n
        return a, b

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes, int]]:
        k = len(self.runs)
        while k and (row := self.row[w := self.winner]):
            yield row[0], row[1], row[2], self.lcp[w]
            self.step(w)
            node = (k + w) // 2
            while node:
                w, self.losers[node] = self.play(w, self.losers[node])
                node //= 2
            self.winner = w


class Node:
    """An open node and what its subtree adds up to so far: n conversations, least the smallest, children, leaves, saved. number is
    its place in the order in which nodes open; ends the text of the ids that end there, sha their digest as far as known."""

    __slots__ = ("children", "depth", "digest", "ends", "least", "leaves", "n", "number", "parent", "saved", "sha", "words")

    def __init__(self, number: int, parent: Node | None, words: int, digest: bytes):
        self.number, self.parent, self.words, self.digest, self.ends, self.sha = number, parent, words, digest, b"", None
        self.depth = parent.depth + 1 if parent else 0
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None

    def add(self, n: int, least: int | None, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.n += n
        self.least = least if self.least is None else self.least if least is None else min(self.least, least)
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def ended(self) -> None:
        """Nothing more comes beneath it: its sums are whole and go to its parent."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.words
        if self.parent:
            self.parent.add(self.n, self.least, 1, self.leaves, self.saved)

    def sums(self) -> tuple:
        return self.least, self.depth, self.n, self.children, self.leaves, self.saved


class Range:
    """The nodes of one range of merged paths.

    A node on the first or on the last path may have more in other ranges. It goes on as it is, without what other such nodes add to
    it, under a slot: first those of the first path from the root down, then what is left of the last."""

    def __init__(self) -> None:
        self.up, self.sums = array("q"), [array("q") for _ in range(6)]
        self.ends: dict[int, bytes] = {}
        self.stack: list[Node] = []
        self.spine: list[Node] = []

    def push(self, words: int, digest: bytes) -> Node:
        parent = self.stack[-1] if self.stack else None
        node = Node(len(self.up), parent, words, digest)
        self.up.append(parent.number if parent else -1)
        for column in self.sums:
            column.append(0)
        self.stack.append(node)
        return node

    def read(self, merged: Iterator[tuple[bytes, int, bytes, int]]) -> Range:
        """Nodes are noted when they end, by number, as a node's parent has its smallest id only when that ends, too."""
        row = next(merged, None)
        if row is None:
            return self
        self.push(0, b"")
        self.descend(row[0], row[2], 0)
        first, ids = self.stack[:], [row[1]]

        def told() -> None:
            """The ids that end at the open path stand together, and in order."""
            self.stack[-1].add(len(ids), ids[0])
            self.stack[-1].ends = ",".join(map(str, ids)).encode()

        for path, conv, words, lcp in merged:
            if lcp == len(self.stack) - 1 and len(path) == lcp * DIGEST:
                ids.append(conv)
                continue
            told()
            ids = [conv]
            while len(self.stack) > lcp + 1:
                node = self.stack.pop()
                if node.number >= len(first):
                    node.ended()
                    for column, x in zip(self.sums, node.sums()):
                        column[node.number] = x
                    if node.ends:
                        self.ends[node.number] = hashlib.sha256(node.ends).digest()
            self.descend(path, words, lcp)
        told()
        self.spine = [*first, *(x for x in self.stack if x.number >= len(first))]
        return self

    def descend(self, path: bytes, words: bytes, known: int) -> None:
        for d in range(known, len(path) // DIGEST):
            self.push(int.from_bytes(words[4 * d : 4 * d + 4], "big"), path[d * DIGEST : (d + 1) * DIGEST])

    def rows(self) -> Iterator[tuple]:
        """kind, slot, up, parent_conv_id, conv_id, depth, SUMS, ends_sha256, digest, words and ends of each node. kind 0: its sums are
        whole; 1: so they are, but its parent is the node in slot up; 2: a node in a slot."""
        slots = {x.number: k for k, x in enumerate(self.spine)}
        for x in self.spine:
            yield 2, slots[x.number], None, None, *x.sums(), None, x.digest, x.words, x.ends
        for i, up in enumerate(self.up):
            if i not in slots:
                there = slots.get(up)
                yield int(there is not None), None, there, None if there is not None else self.sums[0][up], *(c[i] for c in self.sums), self.ends.get(i, NONE), None, None, None


#: The digest of no text.
NONE = hashlib.sha256(b"").digest()
WHOLE = f"conv_id long, depth long, {', '.join(f'{c} long' for c in SUMS)}, ends_sha256 binary"
RANGE_ROWS = f"part int, kind int, slot int, up int, parent_conv_id long, {WHOLE}, digest binary, words int, ends binary"
SEAM_ROWS = f"part int, slot int, number long, up long, {WHOLE}"


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def ranges(runs: DataFrame) -> DataFrame:
    """The rows of all ranges (RANGE_ROWS). Paths that many conversations have are dealt to several ranges by conv_id."""
    size = runs.agg(F.sum(F.length("path") + ROW).alias("size")).first()["size"] or 0
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    dealt = runs.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("run", "nth")
    schema = to_arrow_schema(StructType.fromDDL(RANGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, known = TaskContext.get().partitionId(), [], None
        for batch in slices(batches):
            for run, path, conv, words, lcp in columns(batch, "run", "path", "conv_id", "words", "lcp"):
                if run != known:
                    own.append([])
                    known, lcp = run, 0  # the one before it in its run is in another range
                own[-1].append((path, conv, words, lcp))
        yield from batched(((part, *row) for row in Range().read(iter(LoserTree([iter(r) for r in own]))).rows()), schema)

    return arrowed(dealt, run, RANGE_ROWS)


def seams(spines: DataFrame) -> DataFrame:
    """The nodes on the ranges' first and last paths, put together in one task, which holds one open path: for each row of spines its
    part, slot and node (number), and each node's sums, with its parent (up), when it ends. The ids that end at a node are digested
    as they come."""
    schema = to_arrow_schema(StructType.fromDDL(SEAM_ROWS))

    def put(rows: Iterator[tuple]) -> Iterator[tuple]:
        stack: list[Node] = []
        count = 0

        def closed(keep: int) -> Iterator[tuple]:
            while len(stack) > keep:
                node = stack.pop()
                node.ended()
                yield None, None, node.number, node.parent.number if node.parent else None, *node.sums(), node.sha.digest() if node.sha else NONE

        for part, slot, digest, words, depth, least, n, children, leaves, saved, ends in rows:
            if len(stack) <= depth or stack[depth].digest != digest:
                yield from closed(depth)
                stack.append(Node(count, stack[-1] if stack else None, words, digest))
                count += 1
            node = stack[depth]
            node.add(n, least, children, leaves, saved)
            if ends:
                node.sha, comma = node.sha or hashlib.sha256(), b"," if node.sha else b""
                node.sha.update(comma + ends)
            yield part, slot, node.number, *[None] * 8
        yield from closed(0)

    names = ("part", "slot", "digest", "words", "depth", "conv_id", *SUMS, "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(put(chain.from_iterable(columns(batch, *names) for batch in slices(batches))), schema)

    return arrowed(spines.select(*names).repartition(1).sortWithinPartitions("part", "slot"), run, SEAM_ROWS)


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of paths (conv_id, path, words, as of paths_of()): conv_id (the smallest of its conversations), depth,
    parent_conv_id (of its parent; null for the root), n_convs, n_children, n_leaves (of its subtree), saved_tokens (over its
    subtree: the words of a node's last turn for each conversation after the first) and ends_sha256 (of the ids of those that end
    there, in order, joined by commas). A conversation without turns ends at the root; without conversations there is no node."""
    found = settled(ranges(settled(sorted_runs(paths))))
    joints = settled(seams(found.where("kind = 2")))
    nodes = joints.where("part is null")
    ids = nodes.select(F.col("number").alias("_number"), F.col("conv_id").alias("_conv"))
    places = joints.where("part is not null").join(ids, F.col("number") == F.col("_number")).select(F.col("part").alias("_part"), F.col("slot").alias("_slot"), "_conv")
    told = ("conv_id", "depth", "parent_conv_id", *SUMS, F.lower(F.hex("ends_sha256")).alias("ends_sha256"))
    inner = found.where("kind = 0").select(*told)
    hung = found.where("kind = 1").drop("parent_conv_id").join(places, (F.col("part") == F.col("_part")) & (F.col("up") == F.col("_slot"))).withColumnRenamed("_conv", "parent_conv_id")
    outer = nodes.join(ids, F.col("up") == F.col("_number"), "left").withColumnRenamed("_conv", "parent_conv_id")
    return inner.unionByName(hung.select(*told)).unionByName(outer.select(*told))
