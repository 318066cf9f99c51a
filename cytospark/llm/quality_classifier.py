"""A factorisation machine that scores the quality of texts.

A text is a sparse vector: its words, hashed into cells and scaled to the length 1, statistics of its structure, and its length as
the table has it. The score is linear in the features and in all products of two of them, whose weights are inner products
of RANK numbers for each feature. Half the difference between the square of a sum and the sum of squares gives all of these
products at once, so a text is scored in time linear in its distinct words.

The machine is fitted on the driver to a bounded sample of labelled rows; every text is then scored in its task, and nothing is
shuffled.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrowed, columns, settled, slices

#: Cells of hashed words, and numbers for each feature in the products' weights.
CELLS, RANK = 1 << 13, 8
#: Labelled documents to fit to at most: those of the smallest hashes of their ids. The driver gets their vectors, 8 bytes for each
#: feature that isn't 0, so 400 MB if every one of them has words in all cells.
LABELLED = 6_000
#: Passes over the sample, documents of a step, its size, and how fast weights without use fade.
PASSES, STEP, RATE, FADE = 14, 128, 0.02, 2e-4
#: The score from which on a text counts as good.
GOOD = 0.3
SYMBOLS = b"#*$%&|<>"
STATISTICS = (
    "words", "word_length", "capitals", "digits", "symbols", "marks", "beyond_ascii", "distinct", "commonest", "stutters", "pairs",
    "lines", "repeated_lines", "unended", "length", "no_length",
)


def statistics(data: bytes, words: list[bytes], counts: Counter, length: int | None) -> list[float]:
    """STATISTICS of a text in UTF-8; length is its code points as the table has them."""
    n, lines = len(words), [x for x in data.split(b"\n") if x.strip()]
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    inner = int(seen.sum() - seen[[0x20, *range(0x09, 0x0E)]].sum())
    share = lambda a, b: float(a) / b if b else 0.0
    return [
        np.log1p(n),
        share(inner, n),
        share(seen[65:91].sum(), inner),
        share(seen[48:58].sum(), inner),
        share(seen[list(SYMBOLS)].sum(), n),
        share(seen[list(b"!?")].sum(), n),
        share(seen[128:].sum(), inner),
        share(len(counts), n),
        share(max(counts.values(), default=0), n),
        share(sum(map(operator.eq, words, words[1:])), n),
        share(len(set(zip(words, words[1:]))), n),
        np.log1p(len(lines)),
        share(len(lines) - len(set(lines)), len(lines)),
        float(bool(lines) and lines[-1].rstrip()[-1:] not in b".!?"),
        np.log1p(length or 0),
        float(length is None),
    ]


def vector(text: str | None, length: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The cells of a text's words, their values, and its statistics. A null text counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    counts = Counter(words)
    cells = np.fromiter((zlib.crc32(w) % CELLS for w in counts), np.int64, len(counts))
    sums = np.bincount(cells, np.fromiter(counts.values(), np.float64, len(counts)), CELLS) if counts else np.zeros(CELLS)
    there = np.flatnonzero(sums)
    return there, sums[there] / (np.linalg.norm(sums) or 1.0), statistics(data, words, counts, length)


@dataclass(frozen=True)
class Machine:
    """bias, and for each feature (the cells, then the statistics) a weight and RANK factors; statistics are shifted by mean, divided by
    spread, and kept within 4."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def features(self, vectors: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's features begin, the features, and their values."""
        own = np.clip((np.array([s for _, _, s in vectors]) - self.mean) / self.spread, -4, 4)
        more = np.arange(CELLS, CELLS + len(STATISTICS))
        begins = np.cumsum([0, *(len(c) + len(more) for c, _, _ in vectors[:-1])])
        return begins, np.concatenate([x for c, _, _ in vectors for x in (c, more)]), np.concatenate([x for (_, v, _), s in zip(vectors, own) for x in (v, s)])

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> np.ndarray:
        if not vectors:
            return np.empty(0)
        return sigmoid(self.bias + products(*self.features(vectors), self.weights, self.factors)[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def products(begins: np.ndarray, at: np.ndarray, values: np.ndarray, weights: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the linear part and all products of two features; the sums of factors by text, and the factors of each feature
    times its value."""
    parts = factors[at] * values[:, None]
    sums = np.add.reduceat(parts, begins)
    pairs = (sums**2).sum(1) - np.add.reduceat((parts**2).sum(1), begins)
    return np.add.reduceat(weights[at] * values, begins) + pairs / 2, sums, parts


def fitted(vectors: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray) -> Machine:
    """The machine of the least log loss on vectors and their labels (0 to 1), by stochastic steps of adapted size. The same rows in
    the same order give the same machine; without rows all scores are a half."""
    n, size = len(vectors), CELLS + len(STATISTICS)
    rng = np.random.default_rng(13)
    share = (labels.sum() + 1) / (n + 2)
    stats = np.array([s for _, _, s in vectors]).reshape(n, len(STATISTICS))
    mean, spread = (stats.mean(0), stats.std(0)) if n else (np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    table = rng.normal(0, 0.02, (size, RANK + 1)) if n else np.zeros((size, RANK + 1))
    table[:, 0] = 0
    machine = Machine(0.0, table[:, 0], table[:, 1:], mean, np.where(spread > 1e-9, spread, 1.0))
    bias, first, second, steps = float(np.log(share / (1 - share))), np.zeros_like(table), np.zeros_like(table), 0
    for turn in range(PASSES if n else 0):
        order = rng.permutation(n)
        for i in range(0, n, STEP):
            own = order[i : i + STEP]
            begins, at, values = machine.features([vectors[j] for j in own])
            told, sums, parts = products(begins, at, values, table[:, 0], table[:, 1:])
            wrong = (sigmoid(bias + told) - labels[own]) / len(own)
            owner = np.repeat(np.arange(len(own)), np.diff([*begins, len(at)]))
            slope = wrong[owner] * values
            gradient = np.empty_like(table)
            gradient[:, 0] = np.bincount(at, slope, size)
            for k in range(RANK):
                gradient[:, k + 1] = np.bincount(at, slope * (sums[owner, k] - parts[:, k]), size)
            gradient += FADE * table
            steps += 1
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient**2 - second)
            rate = RATE * (1 - turn / PASSES)
            table -= rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
            bias -= rate * wrong.sum() * 10
    return Machine(bias, table[:, 0].astype(np.float32), table[:, 1:].astype(np.float32), machine.mean, machine.spread)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learned from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def texts_of(docs: DataFrame, doc_id: str, text: str, length: str | None) -> DataFrame:
    n = F.col(length).cast("long") if length in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), n.alias("n_chars"))


def sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", label: str = "quality") -> tuple[list, np.ndarray]:
    """Vectors and labels (the mean of a document's) of most documents at most that aren't held out: of the labelled ids those with the
    smallest hashes, and of rows that share an id the one with the least text."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("_label")).where("_id is not null and _label is not null").where(~held_out(F.col("_id")))
    chosen = settled(known.groupBy("_id").agg(F.avg("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most))
    rows = texts_of(docs, doc_id, text, length).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # most rows
    rows = rows.groupBy("doc_id", "_label").agg(F.min(F.struct("text", "n_chars")).alias("row")).select("doc_id", "_label", "row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [vector(*r) for r in columns(batch, "text", "n_chars")]
            cells, values, stats = zip(*found) if found else ((), (), ())
            arrays = [*batch.select(["doc_id", "_label"]).columns, pa.array([c.astype(np.int32) for c in cells], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for v in values], pa.list_(pa.float32())), pa.array(stats, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "cells", "values", "stats"])

    got = arrowed(rows, run, "doc_id long, label double, cells array<int>, values array<float>, stats array<double>").toArrow().sort_by("doc_id").combine_chunks()
    lists = lambda c: [x.values.to_numpy() for x in got.column(c)]
    vectors = list(zip((c.astype(np.int64) for c in lists("cells")), lists("values"), (s.tolist() for s in lists("stats"))))
    return vectors, got.column("label").to_numpy()


def learned(docs: DataFrame, labels: DataFrame, most: int = LABELLED, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", label: str = "quality") -> Machine:
    """The machine of the labelled documents; see sample(). Language, source and id are no features."""
    return fitted(*sample(docs, labels, most, doc_id, text, length, label))


def scored(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """doc_id, held_out, score (the probability of being good) and predicted (1 from GOOD on) of each row; a null text counts as empty,
    rows that repeat get a row each, and a table without the column length is scored as if that were null. No shuffle; the
    machine that is broadcast has (CELLS + STATISTICS) x (RANK + 1) numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = sent.value.scores([vector(*r) for r in columns(batch, "text", "n_chars")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = arrowed(texts_of(docs, doc_id, text, length), run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
