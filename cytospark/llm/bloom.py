"""A blocked Bloom filter over 64-bit digests or ids: each one sets BITS bits within one block of 512."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrowed

#: Words of 64 bits in a block: one cache line.
WORDS = 8
#: Blocks at most: 16 MB, whatever the number of entries. More entries make more false hits, which an exact join removes.
MOST_BLOCKS = 1 << 18
#: Bits that an entry sets in its block.
BITS = 6


def mixed(h: np.ndarray) -> np.ndarray:
    """Numbers whose bits all depend on all bits of h, no two alike, so that plain ids spread over the blocks as digests do."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each digest, and its bits (one row of WORDS words for each)."""
    h = mixed(h.view(np.uint64))
    block = (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
    mask = np.zeros((len(h), WORDS), np.uint64)
    rows, g = np.arange(len(h)), h
    for _ in range(BITS):
        g = g * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15)
        bit = g >> np.uint64(55)  # 0 to 511
        mask[rows, (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
    return block, mask


def passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which digests may be in the filter: all that are, and some more."""
    block, mask = places(h, len(words))
    return ((words[block] & mask) == mask).all(1)


def holds(words: np.ndarray, ids: pa.Array) -> np.ndarray:
    """The same of a column of ids; nulls are in no filter."""
    return passes(words, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)


def build(digests: DataFrame, entries: int) -> np.ndarray:
    """The filter of the only column of digests (long): blocks x WORDS words, for so many entries and of 16 MB at most. Tasks
    turn digests into bits and Spark ORs them by block; the driver gets the blocks."""
    blocks = int(min(MOST_BLOCKS, 1 << max(6, (max(1, entries) // 32).bit_length())))
    names = [f"w{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, mask = places(batch.column(0).to_numpy(zero_copy_only=False), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(mask[:, i].view(np.int64)) for i in range(WORDS))] if len(block) else [pa.array([], pa.int64())] * (WORDS + 1), names=["block", *names])

    digests = digests.where(F.col(digests.columns[0]).isNotNull())
    got = arrowed(digests, run, "block long, " + ", ".join(f"{n} long" for n in names)).groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names)).toArrow()
    out = np.zeros((blocks, WORDS), np.uint64)
    if got.num_rows:
        out[got.column("block").to_numpy()] = np.stack([got.column(n).to_numpy().view(np.uint64) for n in names], 1)
    return out


def parted(df: DataFrame, column: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose column (long) is in the only column of wanted, with a few more; and all others, also those with a null.
    So a join moves little. No shuffle of df."""
    sent = df.sparkSession.sparkContext.broadcast(build(wanted, wanted.count()))

    def side(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                there = holds(sent.value, batch.column(batch.schema.get_field_index(column)))
                yield batch.filter(pa.array(there == inside, pa.bool_()))

        return arrowed(df, run, df.schema)

    return side(True), side(False)
