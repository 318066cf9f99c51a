"""Language identification as a mixture: each document's language shares by expectation-maximisation.

A language's model is the smoothed distribution of its hashed character trigrams. A document's trigrams are taken as
draws from a mixture of the languages; EM finds the shares, and a language joins the document's set only if the
likelihood grows by more than the penalty for one more parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrowed, columns, slices, with_fields

#: Cells that trigrams are hashed to.
CELLS = 1 << 15
#: Languages that a model can have, so that it fits in a task; with more labels than that, learning is an error.
MOST = 256
LETTER = regex.compile(r"\p{L}")
ROUNDS = 12
#: Trigrams overlap, so that three of them count as one draw.
DRAWS = 3.0

_blank = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def trigrams(text: str) -> np.ndarray:
    """How often each cell occurs in the text, lower-cased, with ASCII characters other than letters as blanks."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(codes < 128, _blank[np.minimum(codes, 127)], codes)
    h = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x27D4EB2F)) >> np.uint32(17)
    dull = (codes[:-2] == 32) & (codes[1:-1] == 32)
    return np.bincount(h[~dull], minlength=CELLS)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages (sorted) and the logarithms of their cells' probabilities, from all rows with neither null. Counts are
    added up within tasks before the shuffle; the result has CELLS numbers for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for t, name in columns(batch, text, lang):
                if name not in counts:
                    counts[name] = np.zeros(CELLS, np.int64)
                counts[name] += trigrams(t)
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "cell", "n"])

    own = docs.where(docs[text].isNotNull() & docs[lang].isNotNull()).select(docs[text].alias(text), docs[lang].alias(lang))
    if len(own.select(lang).distinct().limit(MOST + 1).collect()) > MOST:  # before anything else of them comes to the driver
        raise ValueError(f"more than {MOST} languages; a model has {MOST} at most")
    sums = arrowed(own, run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    rows = sums.toArrow().to_pydict()
    names = sorted(set(rows["lang"]))
    counts = np.full((len(names), CELLS), 0.5)
    np.add.at(counts, ([names.index(x) for x in rows["lang"]] if names else [], rows["cell"]), rows["n"])
    return names, np.log(counts / counts.sum(1, keepdims=True)) if names else counts


def unlearned() -> tuple[list[str], np.ndarray]:
    """A model of one language without a name, '', for tables from which none can be learned: it takes every text with a letter."""
    return [""], np.full((1, CELLS), -np.log(CELLS))


def mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """The shares of the languages whose cells' probabilities are p's rows, and the log-likelihood of the counts n."""
    share = np.full(len(p), 1 / len(p))
    for _ in range(ROUNDS if len(p) > 1 else 0):
        joint = share[:, None] * p
        share = (joint * (n / joint.sum(0))).sum(1)
        share /= share.sum()
    return share, float(n @ np.log(share @ p))


def languages_of(text: str | None, logs: np.ndarray) -> tuple[list[int], list[float]]:
    """The languages of a text, the largest share first, and all shares; none for a null text or one without letters."""
    if not text or not len(logs) or not LETTER.search(text):
        return [], []
    counts = trigrams(text)
    cells = np.flatnonzero(counts)
    n, own = counts[cells] / DRAWS, logs[:, cells]
    p = np.exp(own)
    shares, _ = mixture(p, n)
    # the likeliest language alone, then those that explain enough more
    alone = own @ n
    chosen, best = [int(alone.argmax())], float(alone.max())
    penalty = 0.5 * np.log(max(n.sum(), 2)) + np.log(max(len(logs), 2))
    for k in map(int, np.argsort(-shares)):
        if k in chosen or shares[k] < 0.02:
            continue
        more, gained = mixture(p[[*chosen, k]], n)
        if gained - best > penalty:
            chosen, best = [*chosen, k], gained
    final, _ = mixture(p[chosen], n)
    order = np.argsort(-final, kind="stable")
    full = np.zeros(len(logs))
    full[chosen] = final
    # beside the shares in the chosen set, the full mixture's doubt
    score = np.minimum(full, np.maximum(shares, 1e-6)) if len(chosen) == 1 else full
    return [chosen[i] for i in order], [float(min(1.0, max(0.0, score[chosen[i]]))) for i in order]


def identify(docs: DataFrame, names: list[str], logs: np.ndarray, text: str = "text") -> DataFrame:
    """docs with lang_pred (the language of the largest share; 'und' for a null text or one without a letter), score (its
    share, 0 for 'und') and languages (all of the set with their shares). Columns of these names are replaced; repeated
    rows are judged each. The model goes along with the tasks: MOST x CELLS numbers at most. No shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(logs)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    schema = with_fields(docs, rest, "lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    pairs = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [languages_of(t, model.value) for (t,) in columns(batch, text)]
            arrays = [
                pa.array([names[k[0]] if k else "und" for k, _ in found], pa.string()),
                pa.array([s[0] if s else 0.0 for _, s in found], pa.float64()),
                pa.array([[{"lang": names[a], "share": b} for a, b in zip(k, s)] for k, s in found], pairs),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "lang_pred", "score", "languages"])

    return arrowed(docs.select(rest), run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of the labelled documents that aren't held out."""
    return learn(docs.where(~held_out(docs["doc_id"])))
