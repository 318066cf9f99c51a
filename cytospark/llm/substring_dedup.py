"""Removal of passages that stand in an earlier document: repeated-phrase automata.

1. Every window of so many words has an anchor, the run of GRAM words in it with the smallest digest. Equal windows have
   equal anchors, so a window can recur only if its anchor stands in two documents.
2. The texts around such anchors are the phrases, in which alone a window can recur. Each document's phrases go, as digests
   made of 128 bits of each word, to the shards of their anchors; a phrase that many documents share goes there once, and
   its words are taken once, from the first document that has it.
3. A shard confirms, by their words, the windows that stand in two documents, compiles them into automata, a bounded number
   at a time, and streams the phrases of all documents through them. What an automaton finds in a phrase are the passages
   of earlier documents.
4. The places of phrases in documents are joined with what was found in them. Each document then loses the words of all
   windows that a document with a smaller id has, too.

A frequent anchor stands in many different phrases; its windows go to shards by their own words instead, so that a key of a
shard has HOT rows at most. The filters of shared and of frequent anchors have a fixed size and only save work: what the
first lets through in error is a phrase without a confirmed window, and an anchor that the second takes for a frequent one is
treated like it in every document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import WORD, arrowed, columns, renamed, settled, slices, words_of
from .wordhash import runs, word_digests

#: Words of an anchor.
GRAM = 5
#: Rows of an anchor from which on it counts as frequent.
HOT = 500
#: Windows from which on a shard compiles the next automaton. All first words stand at an automaton's root, where they are looked
#: up one by one, so that large ones are slow.
COMPILED = 1_000


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The place of the anchor of each window of words with the digests h: of the runs of GRAM words in it, the first of those
    whose digests have the least upper half. None if there are too few words."""
    gram = min(GRAM, window)
    if len(h) < window:
        return np.empty(0, np.int64)
    g = runs(h, gram)
    low = np.uint64(0xFFFFFFFF)
    least, width = (g & ~low) | np.arange(len(g), dtype=np.uint64), 1
    while width < window - gram + 1:  # the least of twice as many at a time
        step = min(width, window - gram + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least & low).astype(np.int64)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """The texts in UTF-8, empty for nulls and for rows without an id."""
    text = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
    ids = batch.column(batch.schema.get_field_index("doc_id")).is_valid().to_pylist()
    return [t if t and ok else b"" for t, ok in zip(text, ids)]


class Anchored:
    """The runs of windows with one anchor in several texts: doc (the text's number), anchor, first and last (window of the
    run, by the number of its first word in all texts)."""

    def __init__(self, texts: list[bytes], window: int):
        self.blob, self.window = b"\n".join(texts), window
        self.words, self.more, self.starts, self.ends = word_digests(self.blob)
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.starts, "right")
        self.begins = np.searchsorted(doc, np.arange(len(texts)))
        at = anchors(self.words, window)
        inside = np.flatnonzero(doc[: len(at)] == doc[len(doc) - len(at) :])  # windows of one text
        new = np.flatnonzero((np.diff(at[inside], prepend=-1) != 0) | (np.diff(doc[inside], prepend=-1) != 0))
        self.first = inside[new]
        self.last = inside[np.append(new[1:], len(inside)) - 1] if len(inside) else self.first
        self.doc = doc[self.first]
        self.anchor = runs(self.words, min(GRAM, window))[at[self.first]]

    def phrase(self, first: int, last: int) -> bytes:
        """The words of some windows, joined by blanks."""
        return b" ".join(self.blob[self.starts[first] : self.ends[last + self.window - 1]].split())


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """anchor and doc_id, about once for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = Anchored(texts_of(batch), window)
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(found.doc))
            yield pa.RecordBatch.from_arrays([pa.array(found.anchor.view(np.int64)), ids], names=["anchor", "doc_id"])

    return arrowed(docs, run, "anchor long, doc_id long")


def mixed(*parts: np.ndarray) -> np.ndarray:
    """Digests of several columns of numbers, side by side."""
    h = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for x in parts:
            h = (h ^ x.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


class Phrases:
    """Finds the phrases of texts: around the anchors that pass the filter of shared ones, but single windows around those that
    pass the filter of frequent ones, too."""

    def __init__(self, shared: np.ndarray, frequent: np.ndarray):
        self.shared, self.frequent = shared, frequent

    def of(self, found: Anchored) -> tuple[np.ndarray, ...]:
        """Of each phrase: key, digest of the words (from 128 bits of each), number of the text, first and last window. The first and the
        last window have all of its words, as a run of windows with one anchor is no longer than a window."""
        hit = np.flatnonzero(bloom.passes(self.shared, found.anchor))
        hot = bloom.passes(self.frequent, found.anchor[hit])
        n = np.where(hot, found.last[hit] - found.first[hit] + 1, 1)
        owner = np.repeat(np.arange(len(hit)), n)
        first = found.first[hit][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        last = np.where(hot[owner], first, found.last[hit][owner])
        one, two = (runs(h, found.window) for h in (found.words, found.more))
        digest = mixed(one[first], two[first], one[last], two[last], last - first)
        key = np.where(hot[owner], mixed(one[first]), found.anchor[hit][owner].view(np.int64))
        return key, digest, found.doc[hit][owner], first, last


def places(docs: DataFrame, phrases: Phrases, window: int) -> DataFrame:
    """key, phrase_key, doc_id, text_key, start of every phrase in every document."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = Anchored(texts_of(batch), window)
            key, digest, doc, first, _ = sent.value.of(found)
            own = batch.select(["doc_id", "text_key"]).take(pa.array(doc))
            start = pa.array((first - found.begins[doc]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(digest), *own.columns, start], names=["key", "phrase_key", "doc_id", "text_key", "start"])

    return arrowed(docs, run, "key long, phrase_key long, doc_id long, text_key long, start int")


def firsts_of(ends: DataFrame) -> DataFrame:
    """The digests of phrases (key, phrase_key, first) in their first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = mixed(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])

    return arrowed(ends.select("key", "phrase_key", "first"), run, "h long")


def spoken(docs: DataFrame, phrases: Phrases, firsts: np.ndarray, window: int) -> DataFrame:
    """key, phrase_key and the words (phrase) of each phrase from its first document, and now and then from another."""
    sent = docs.sparkSession.sparkContext.broadcast((phrases, firsts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, filt = sent.value
        for batch in slices(batches):
            found = Anchored(texts_of(batch), window)
            key, digest, doc, first, last = finder.of(found)
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(doc)).to_numpy(zero_copy_only=False)
            ok = np.flatnonzero(bloom.passes(filt, mixed(key, digest, ids.astype(np.int64, copy=False))))
            words = [found.phrase(a, b) for a, b in zip(first[ok].tolist(), last[ok].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(digest[ok]), pa.array(words, pa.binary())], names=["key", "phrase_key", "phrase"])

    return arrowed(docs, run, "key long, phrase_key long, phrase binary")


def located(group: list[tuple[int, int, bytes, int, int]], window: int) -> Iterator[tuple[int, int, list[int | None]]]:
    """For phrases (key, phrase_key, phrase, first, last), of which first and last are the smallest and the largest id of their
    documents: key, phrase_key, and for each window the smallest id of the documents that it stands in, if there are
    several. Windows are confirmed by their words; an automaton of the confirmed ones, over word numbers, then runs through
    all phrases."""
    numbers: dict[bytes, int] = {}
    spans: dict[tuple[int, ...], tuple[int, int]] = {}
    streams = []
    for key, phrase_key, phrase, first, last in group:
        words = tuple([numbers.setdefault(w, len(numbers)) for w in phrase.split(b" ")])
        streams.append((key, phrase_key, words))
        for i in range(len(words) - window + 1):
            w = words[i : i + window]
            lo, hi = spans.get(w, (first, last))
            spans[w] = (min(lo, first), max(hi, last))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for w, (lo, hi) in spans.items():
        if lo < hi:
            automaton.add_word(w, lo)
    if not len(automaton):
        return
    automaton.make_automaton()
    for key, phrase_key, words in streams:
        found: list[int | None] = [None] * (len(words) - window + 1)
        for end, first in automaton.iter(words):
            found[end - window + 1] = first
        if any(x is not None for x in found):
            yield key, phrase_key, found


def shards(ends: DataFrame, phrases: DataFrame, window: int) -> DataFrame:
    """key, phrase_key and firsts of the phrases with confirmed windows. ends (key, phrase_key, first, last) and phrases (key,
    phrase_key, phrase) of a key lie in one partition, side by side, ends first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        known: dict[int, tuple[int, int]] = {}
        n, key = 0, None

        def done() -> pa.RecordBatch:
            found = list(located(group, window))
            k, p, f = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(p, pa.int64()), pa.array(f, pa.list_(pa.int64()))], names=["key", "phrase_key", "firsts"])

        for batch in slices(batches):
            for k, p, phrase, first, last in columns(batch, "key", "phrase_key", "phrase", "first", "last"):
                if k != key:
                    key, known = k, {}
                    if n >= COMPILED:
                        yield done()
                        group, n = [], 0
                if phrase is None:
                    known[p] = (first, last)
                elif p in known:  # not seen before in this key
                    group.append((k, p, phrase, *known.pop(p)))
                    n += phrase.count(b" ") + 2 - window
        yield done()

    both = ends.select("key", "phrase_key", F.lit(None).cast("binary").alias("phrase"), "first", "last").unionByName(phrases.select("key", "phrase_key", "phrase", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last")))
    sorted_ = both.repartition("key").sortWithinPartitions("key", F.col("phrase").isNotNull())
    return arrowed(sorted_, run, "key long, phrase_key long, firsts array<long>")


def repeated_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """By doc_id and text_key, starts: the places of all windows that start in a document with a smaller id, too; runs of them
    as place << 32 | number. docs has doc_id, text and text_key (a digest of the text, which tells rows with the same id
    apart)."""
    counted = anchor_rows(docs, window).groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = settled(counted.where("first < last").select("anchor", "n"))
    size = shared.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") > HOT).alias("hot")).first()
    frequent = bloom.build(shared.where(F.col("n") > HOT).select("anchor"), size["hot"])
    phrases = Phrases(bloom.build(shared.select("anchor"), size["n"]), frequent)
    at = settled(places(docs, phrases, window))
    ends = settled(at.groupBy("key", "phrase_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    found = shards(ends, spoken(docs, phrases, bloom.build(firsts_of(ends), ends.count()), window), window)
    own = "filter(transform(firsts, (x, i) -> if(x < doc_id, i, cast(null as int))), i -> i is not null)"
    hits = at.join(found, ["key", "phrase_key"]).select("doc_id", "text_key", "start", F.size("firsts").alias("n"), F.expr(own).alias("own")).where("size(own) > 0")
    place = F.shiftleft(F.col("start").cast("long"), 32)
    codes = F.when(F.size("own") == F.col("n"), F.array(place + F.col("n"))).otherwise(F.transform("own", lambda i: F.shiftleft((F.col("start") + i).cast("long"), 32) + 1))
    return hits.select("doc_id", "text_key", F.explode(codes).alias("s")).groupBy("doc_id", "text_key").agg(F.collect_list("s").alias("starts"))


def covered(n: int, starts: list[int], window: int) -> np.ndarray:
    """Which of n words lie in a window of one of the runs."""
    edges = np.zeros(n + 1, np.int32)
    s = np.array(starts, np.int64)
    np.add.at(edges, s >> 32, 1)
    np.add.at(edges, (s >> 32) + (s & 0xFFFFFFFF) - 1 + window, -1)
    return np.cumsum(edges[:-1]) > 0


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_key"))


def split(docs: DataFrame, starts: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """docs with _doc_id and _text_key: the rows that may lose words, and the others. Only texts that lose words, and a few more,
    are moved."""
    marked = docs.select("*", docs[doc_id].cast("long").alias("_doc_id"), F.xxhash64(docs[text]).alias("_text_key"))
    some, others = bloom.parted(marked.withColumn("_h", F.xxhash64("_doc_id", "_text_key")), "_h", starts.select(F.xxhash64("doc_id", "text_key").alias("h")))
    return some.drop("_h"), others.drop("_h")


def removal_report(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256 (of the words kept, joined by a blank). A null text has no words;
    rows with a null id keep all of theirs and take nothing from others; of rows that share an id none is earlier. An empty
    table gives an empty one."""
    docs = keyed(docs, doc_id, text)
    starts = settled(repeated_windows(docs, window))
    some, _ = split(docs.select("doc_id", "text"), starts, "doc_id", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = [words_of(t) for (t,) in columns(batch, "text")]
            arrays = [batch.column(0), batch.column(2), pa.array(map(len, w), pa.int64()), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in w], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "n_words", "whole"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, kept = [], []
            for t, s in columns(batch, "text", "starts"):
                w = words_of(t)
                gone = covered(len(w), s, window)
                n.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join([x for x, g in zip(w, gone.tolist()) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.select(["_doc_id", "_text_key"]).columns, pa.array(n, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "text_key", "n_removed", "cut"])

    own = (F.col("_doc_id") == F.col("doc_id")) & (F.col("_text_key") == F.col("text_key"))
    less = some.select("_doc_id", "_text_key", "text").join(starts, own).select("_doc_id", "_text_key", "text", "starts")
    less = arrowed(less, cut, "doc_id long, text_key long, n_removed long, cut string").dropDuplicates(["doc_id", "text_key"])
    rows = arrowed(docs, whole, "doc_id long, text_key long, n_words long, whole string")
    out = rows.join(less, ["doc_id", "text_key"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut", "whole").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the words of repeated windows, each with the white space after it; n_chars, if there is one, is counted
    anew. Rows that lose all of their words go; all others stay, with what is left as it was. Nulls as in removal_report()."""
    columns_, (docs, name) = docs.columns, renamed(docs)
    length, doc_id, text = name.get("n_chars"), name[doc_id], name[text]
    starts = settled(repeated_windows(keyed(docs, doc_id, text), window))
    some, others = split(docs, starts, doc_id, text)
    word = re.compile(WORD)
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, out = batch.schema.get_field_index(text), []
            for t, s in columns(batch, text, "_starts"):
                if s:
                    spans = [m.start() for m in word.finditer(t)]
                    gone = covered(len(spans), s, window).tolist()
                    parts = [t[: spans[0]]] + [t[a:b] for a, b, g in zip(spans, [*spans[1:], len(t)], gone) if not g]
                    t = "".join(parts) if not all(gone) else None
                out.append(t)
            gone = pa.array([bool(s) and t is None for (s,), t in zip(columns(batch, "_starts"), out)], pa.bool_())
            batch = batch.set_column(at, pa.field(text, pa.string()), pa.array(out, pa.string()))
            yield batch.filter(pc.invert(gone)).select(schema.names)

    right = starts.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), F.col("starts").alias("_starts"))
    joined = some.join(right, (F.col("_doc_id") == F.col("_d")) & (F.col("_text_key") == F.col("_t")), "left")
    out = arrowed(joined.drop("_d", "_t", "_doc_id", "_text_key"), cut, schema).unionByName(others.drop("_doc_id", "_text_key"))
    out = out.withColumn(length, F.length(text).cast(schema[length].dataType)) if length else out
    return out.toDF(*columns_)
