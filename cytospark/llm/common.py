"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of code points other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as a set of characters.
WHITE = " \t\n\x0b\x0c\r"
#: Rows, and bytes of them, that are turned into Python objects at a time, so that batches of long texts stay small.
SLICE, SLICE_BYTES = 256, 2 << 20
#: Rows of an Arrow batch, and the setting that bounds it.
BATCH, ARROW_ROWS = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where none is set, a new local one if all runs
    in one process, or else an error, as executors would write to disks of their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: computed once, and safe from lost executors."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns called c0, c1 and so on, so that none of them is taken for a column of an operator's own; and these
    names by the old ones."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def arrowed(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of BATCH rows at most, for this session's plans from here on: texts are long, and a
    batch stands in memory on both sides. A smaller setting of the session's own stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ARROW_ROWS)) <= BATCH:
        conf.set(ARROW_ROWS, BATCH)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return df.mapInArrow(tidy, schema)


def released() -> None:
    """Gives memory that this process no longer uses back to the machine, as Spark keeps Python workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: bytes.split() parts at exactly the six white-space bytes."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def words_col(text: Column) -> Column:
    """The words of a text column as an array, empty for null and for texts without words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches of SLICE rows and SLICE_BYTES at most, or of a single row."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from _halves(batch.slice(at, SLICE))


def _halves(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if n < 2 or batch.nbytes <= SLICE_BYTES:
        yield batch
    else:
        yield from _halves(batch.slice(0, n // 2))
        yield from _halves(batch.slice(n // 2))


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def with_fields(df: DataFrame, columns: list[str], ddl: str) -> StructType:
    """The schema of some columns of df and of further ones."""
    return StructType([df.schema[c] for c in columns] + StructType.fromDDL(ddl).fields)
