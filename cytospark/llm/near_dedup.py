"""Near duplicates by SetSketch registers: bands of registers propose pairs, the likelihood of the registers sorts out what
can't be similar, and full shingle sets confirm the rest.

A register holds the truncated minimum, over a set's elements, of exponentially distributed hash values, on an
exponential scale. Registers of a union are the element-wise maxima of the sets' registers, so sketches merge. Two sets
agree in a register with a probability of at least their Jaccard similarity, which makes bands of registers
locality-sensitive.

Documents with equal shingle sets are one class from the start and only its representative goes on. In a bucket of a few
members all pairs are candidates. In a larger one every member meets the bucket's hub, the member with the most company
over all of its bands: of a cloud of near copies that is one close to their common origin, to which most others are
similar. A confirmed link joins components; what is still in different components then is compared by the rarest shingles
of each set, of which two similar sets must share one. So no pair is lost, and a large group never meets in full.

Texts are read twice, for the sketches and for the words of those documents that share a band. Digests of shingles only propose
pairs; links are confirmed by the shingles' words, and documents are one class by a cryptographic digest of theirs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import bloom
from .common import arrowed, columns, settled, slices
from .wordhash import runs, word_hashes

#: Registers of 16 bits; four make a band, whose key is their 64 bits.
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: The scale: a register grows by one when the minimum shrinks by this factor; A is the rate of the exponentials.
BASE, A, TOP = 1.001, 20.0, (1 << 16) - 2
#: Elements that meet all registers at a time.
BLOCK = 1024
#: Natural logarithm of the likelihood ratio beyond which a pair can't be similar.
SURE = 25.0
#: Members of a bucket of which all pairs are candidates.
FEW = 6
#: Texts that are held against one copy of a text, about.
SEATS = 256


@lru_cache(maxsize=1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    names = [f"register {i}" for i in range(REGISTERS)]
    a = np.array([xxhash.xxh3_64_intdigest(n, 1) | 1 for n in names], np.uint64)
    return a, np.array([xxhash.xxh3_64_intdigest(n, 2) for n in names], np.uint64)


def spoken(text: str | None) -> bytes:
    """The words of a text in UTF-8, joined by blanks, with a-z for A-Z."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def phrases(words: bytes, n: int) -> list[bytes]:
    """The shingles of spoken() words: each run of n words, or of all words if there are fewer; none without words."""
    w = words.split(b" ") if words else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(min(n, len(w)))))))


def shingles(words: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit digests of the shingles of spoken() words, sorted, and a place of each among phrases()."""
    h = word_hashes(words)[0]
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = runs(h, min(n, len(h)))
    if len(h) < n:  # so that a short text isn't taken for a shingle of a longer one
        out += np.uint64(len(h))
    return np.unique(out, return_index=True)


def set_digest(words: bytes, n: int, places: np.ndarray) -> str | None:
    """A digest of the whole set of shingles, from their words; null for the empty one."""
    own = phrases(words, n)
    return hashlib.blake2b(b"\n".join([own[i] for i in places.tolist()]), digest_size=16).hexdigest() if own else None


def registers(elements: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of 64-bit digests: floor(1 - log_b(minimum)), kept within 0 and TOP + 1."""
    a, b = multipliers()
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), BLOCK):
        x = elements[at : at + BLOCK, None] * a
        x += b
        np.minimum(least, x.min(0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / A
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def log_likelihood(j: np.ndarray, u: float, v: float, more: float, fewer: float, equal: float) -> np.ndarray:
    """Of the numbers of registers in which one sketch is above, below and equal, given the similarity j and the shares u and
    v = 1 - u of the two cardinalities."""
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    same = np.maximum(1 - up - down, 1e-12)
    return more * np.log(np.maximum(up, 1e-12)) + fewer * np.log(np.maximum(down, 1e-12)) + equal * np.log(same)


def may_be_similar(one: np.ndarray, two: np.ndarray, n: int, m: int, similarity: float) -> bool:
    """Whether the likelihood of the joint registers, maximised over the similarity, isn't far above the one at the wanted
    similarity. n and m are the sizes of the sets."""
    if min(n, m) < similarity * max(n, m) - 1e-9:
        return False
    u, v = n / (n + m), m / (n + m)
    j = np.linspace(0, min(u / v, v / u), 101)
    counts = (float((one > two).sum()), float((one < two).sum()), float((one == two).sum()))
    wanted = log_likelihood(np.array([min(similarity, j[-1])]), u, v, *counts)[0]
    every = log_likelihood(j, u, v, *counts)
    return bool(j[every.argmax()] >= similarity or every.max() - wanted <= SURE)


def sketched(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the whole set, null for the empty one) and bands (the registers, four to a
    number) of each row."""
    schema = "doc_id long, n_shingles long, set_key string, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, keys, bands = [], [], []
            for (t,) in columns(batch, "text"):
                own = spoken(t)
                s, places = shingles(own, words)
                n.append(len(s))
                keys.append(set_digest(own, words, places))
                bands.append(registers(s).view("<i8") if len(s) else None)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "bands"])

    return arrowed(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), run, schema)


def likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the joint likelihood leaves."""
    one = sketches.select(F.col("node").alias("a"), F.col("bands").alias("ra"), F.col("n_shingles").alias("na"))
    two = sketches.select(F.col("node").alias("b"), F.col("bands").alias("rb"), F.col("n_shingles").alias("nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [np.array(x, "<i8").view(np.uint16) for (x,) in columns(batch, "ra")]
            other = [np.array(x, "<i8").view(np.uint16) for (x,) in columns(batch, "rb")]
            ok = [may_be_similar(x, y, n, m, similarity) for x, y, (n, m) in zip(own, other, columns(batch, "na", "nb"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return arrowed(pairs.join(one, "a").join(two, "b"), run, "a long, b long")


def elements(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """node, spoken (its words) and n (of a shingle) of the documents (doc_id, text) of ids (node) that have words; an id with several
    texts has a row for each. Texts go to their tasks once and don't come back."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom.build(ids, ids.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            some = batch.filter(pa.array(bloom.holds(sent.value, batch.column(0)), pa.bool_()))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([spoken(t) for (t,) in columns(some, "text")], pa.binary())], names=["node", "spoken"])

    found = arrowed(docs.select("doc_id", "text"), run, "node long, spoken binary").where("length(spoken) > 0")
    return settled(found.join(ids, "node", "left_semi").distinct().withColumn("n", F.lit(words)))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets of shingles have the similarity, by the shingles' words; of an id with several texts, any.

    Of a pair, the member with more pairs is the host. A host's text stands once before those of SEATS guests, which are
    streamed past its set; a host of more guests has several such tables, so no task gets all of a hub's pairs."""
    num, den = Fraction(str(similarity)).as_integer_ratio()
    pairs = pairs.distinct()
    company = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    known = pairs.join(company.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a").join(company.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b")
    first = F.col("ka") >= F.col("kb")
    table = F.pmod(F.xxhash64("a", "b"), F.floor(F.greatest("ka", "kb") / SEATS) + 1).cast("int")
    seated = settled(known.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("guest"), table.alias("seat")))
    hosts = seated.select("host", "seat").distinct().join(sets, F.col("host") == F.col("node")).select("host", "seat", F.lit(None).cast("long").alias("guest"), "spoken", "n")
    guests = seated.join(sets, F.col("guest") == F.col("node")).select("host", "seat", "guest", "spoken", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in slices(batches):
            found = []
            for host, seat, guest, words, n in columns(batch, "host", "seat", "guest", "spoken", "n"):
                s = set(phrases(words, n))
                if at != (host, seat):
                    at, own = (host, seat), []
                if guest is None:
                    own.append(s)
                elif any(den * (both := len(s & x)) >= num * (len(s) + len(x) - both) for x in own):
                    found.append((min(host, guest), max(host, guest)))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    met = hosts.unionByName(guests).repartition("host", "seat").sortWithinPartitions("host", "seat", F.col("guest").asc_nulls_first())
    return arrowed(met, run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of links (a, b), by turns of large and small stars: a
    node's larger neighbours, then its smaller ones, move to its smallest neighbour, until nothing moves."""

    def moved(edges: DataFrame, larger: bool) -> DataFrame:
        near = edges if not larger else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.join(least, "u")
        if larger:
            return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u > v").distinct()

    def kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges, settled, and a mark by which the same edges are known."""
        seen = Observation()
        marked = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"))
        return settled(marked), (seen.get["n"], seen.get["h"])

    edges, before = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while before[0]:
        edges, after = kept(moved(moved(edges, True), False))
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def labelled(df: DataFrame, found: DataFrame, node: str = "doc_id") -> DataFrame:
    """df with label: the component of its node, or the node itself."""
    found = found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return df.join(found, df[node] == found["_node"], "left").withColumn("label", F.coalesce("_component", node)).drop("_node", "_component")


def met_hub(many: DataFrame) -> DataFrame:
    """Each member of a bucket (key, node, n) with the bucket's hub: the member whose buckets have the most members in all. As
    many pairs as members at most, and fewer where buckets share their hubs."""
    company = many.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = many.join(company, "node").groupBy("key").agg(F.max(F.struct("company", (-F.col("node")).alias("low"))).alias("hub"))
    pairs = many.join(hubs.select("key", (-F.col("hub.low")).alias("hub")), "key")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).where("a < b").distinct()


def met_all(here: DataFrame) -> DataFrame:
    """Every pair of a bucket's members; for buckets of FEW."""
    there = here.select("key", F.col("node").alias("_node"))
    return here.join(there, "key").where("node < _node").select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct()


def mixed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """buckets with the label of each member, but for those that are in one component altogether."""
    here = labelled(buckets, found, "node")
    ends = here.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return here.join(ends, "key")


def met_by_rarest(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs of nodes (node, label) of different labels that may be similar: of n shingles in the order of their frequency
    among the nodes, similar sets share one of the first n - ceil(similarity * n) + 1. Shingles that only one node has stand
    first, so a text with that many of its own meets no other; nor does a pair meet whose sets, behind their first common
    shingle, have too few left. Of a shingle's nodes, those of its commonest label only meet the
    others."""
    num, den = Fraction(str(similarity)).as_integer_ratio()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(w, k)[0].view(np.int64) for w, k in columns(batch, "spoken", "k")]
            n = [len(x) for x in found]
            at = np.repeat(np.arange(len(found)), n)
            token = np.concatenate([np.empty(0, np.int64), *found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.array(n, np.int64)[at]), pa.array(token)], names=["node", "label", "n", "token"])

    own = nodes.join(sets, "node").select("node", "label", "spoken", F.col("n").alias("k"))
    rows = settled(arrowed(own, run, "node long, label long, n long, token long").distinct())
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    first = (F.col("n") - F.expr(f"(n * {num} + {den - 1}) div {den}") + 1).cast("int")
    ranked = rows.join(often, "token").groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("t"))
    prefix = ranked.select("node", "label", "n", F.posexplode(F.slice("t", F.lit(1), first)).alias("at", "t")).select("node", "label", "n", "at", "t.*")
    prefix = settled(prefix.where("f > 1").drop("f"))
    labels = prefix.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    main = labels.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "main")
    some = prefix.join(main, "token")
    others = some.where("label <> main").select("token", *(F.col(c).alias(f"_{c}") for c in ("node", "label", "n", "at")))
    # what comes after the first common shingle must be enough for the similarity
    enough = (num + den) * F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) >= num * (F.col("n") + F.col("_n"))
    pairs = some.join(others, (some["token"] == others["token"]) & (F.col("label") != F.col("_label")) & enough)
    return pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).where("a < b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (the smallest id reachable over links) and kept (whether it is that).

    Linked are documents whose sets of shingles (of so many words; texts with fewer: all words) have the Jaccard similarity,
    by full sets. A pair at exactly 0.8 stays unseen with a probability of 7e-10 (BANDS bands of ROWS registers). Null, empty
    and wordless texts have no shingles and are linked with nothing. Rows with the same id count as one document with the
    links of each; rows with a null id are kept and get a null component. Only doc_id and text are read."""
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    rows = settled(sketched(docs, words, "doc_id", "text"))
    known = rows.where("doc_id is not null and set_key is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.min_by(F.struct("n_shingles", "bands"), "doc_id").alias("s"))
    classes = settled(classes.select("set_key", "first", "s.*"))
    sketches = classes.select(F.col("first").alias("node"), "n_shingles", "bands")
    members = known.select("doc_id", "set_key").join(classes.select("set_key", "first"), "set_key").where("doc_id <> first")
    links = members.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))

    every = sketches.select("node", F.posexplode("bands").alias("band", "register")).select("node", F.xxhash64("band", "register").alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = settled(every.join(shared, "key"))
    few, many = buckets.where(F.col("n") <= FEW), buckets.where(F.col("n") > FEW)

    good = settled(likely(met_all(few).unionByName(met_hub(many)).distinct(), sketches, similarity))
    ids = settled(good.select(F.explode(F.array("a", "b")).alias("node")).unionByName(many.select("node")).distinct())
    sets = elements(docs, ids, words)
    new = settled(confirmed(good, sets, similarity))
    here = settled(mixed(many, components(new)).select("node", "label").distinct())
    if not here.isEmpty():
        pairs = met_by_rarest(here, sets, similarity)
        new = new.unionByName(settled(confirmed(likely(pairs, sketches, similarity), sets, similarity)))
    links = links.unionByName(new)
    out = labelled(rows.select("doc_id", "n_shingles"), components(links))
    return out.select("doc_id", "n_shingles", F.col("label").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("label"), F.lit(True)).alias("kept"))
