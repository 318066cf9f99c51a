"""Single files that replace their targets all together."""

from __future__ import annotations

import contextlib
import os
import re
import stat
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame


class Outputs:
    """Writes temporary files beside their targets and renames them at commit. If anything fails, every target is as it was."""

    def __init__(self, inputs: Iterable[str] = ()):
        self.inputs = [x for x in inputs if x and os.path.exists(x)]
        self.files: list[tuple[str, str]] = []

    def check(self, target: str) -> None:
        """Raises if a target isn't a plain file, or is an input or another output."""
        if os.path.exists(target) and not stat.S_ISREG(os.stat(target).st_mode):
            raise ValueError(f"{target} isn't a regular file")
        for other in self.inputs:
            if os.path.exists(target) and os.path.samefile(target, other):
                raise ValueError(f"{target} is an input, too")
        if os.path.realpath(target) in (os.path.realpath(t) for t, _ in self.files):
            raise ValueError(f"{target} is named twice")

    def write(self, target: str, lines: Iterable[str], rows: DataFrame | None = None, order: tuple[str, ...] = ()) -> None:
        """Lines of the driver's, then the column value of rows in their order: executors sort and write these as parts to the shared
        folder, of which the bytes are put together."""
        self.check(target)
        handle, temporary = tempfile.mkstemp(prefix=".", suffix=".tmp", dir=os.path.dirname(os.path.abspath(target)))
        self.files.append((target, temporary))
        with os.fdopen(handle, "w", newline="") as f:
            f.writelines(f"{line}\n" for line in lines)
            f.flush()
            os.fsync(f.fileno())
        if rows is not None:
            append_rows(rows, temporary, order)
        os.chmod(temporary, stat.S_IMODE(os.stat(target).st_mode) if os.path.exists(target) else 0o666 & ~_umask())

    def commit(self) -> list[str]:
        done: list[tuple[str, str | None]] = []
        try:
            for target, temporary in self.files:
                backup = None
                if os.path.exists(target):
                    backup = f"{temporary}.old"
                    os.link(target, backup)
                done.append((target, backup))
                os.replace(temporary, target)
        except OSError:
            for target, backup in reversed(done):
                if backup:
                    os.replace(backup, target)
                else:
                    with contextlib.suppress(FileNotFoundError):
                        os.unlink(target)
            self.abandon()
            raise
        for _, backup in done:
            if backup:
                os.unlink(backup)
        out, self.files = [t for t, _ in self.files], []
        return out

    def abandon(self) -> None:
        for _, temporary in self.files:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(temporary)
        self.files = []

    def __enter__(self) -> Outputs:
        return self

    def __exit__(self, kind, *_) -> None:
        self.abandon()


def _umask() -> int:
    now = os.umask(0)
    os.umask(now)
    return now


def lines_of(df: DataFrame, *order: str) -> Iterator[str]:
    """The column value of df in order, a partition at a time."""
    return (row["value"] for row in (df.orderBy(*order) if order else df).select("value").toLocalIterator())


def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """The column value of df as a folder of text parts, sorted over all parts: the sink for results that are large."""
    (df.orderBy(*order) if order else df).select("value").write.text(path)


def append_rows(df: DataFrame, target: str, order: tuple[str, ...] = ()) -> None:
    """Appends the column value of df, in order, to a file of the driver's. Parts are written by the executors in the shared folder
    spark.checkpoint.dir, and their bytes copied one after the other. Where none is named, parts stand beside the target if all
    runs in one process; on a cluster that is an error. Results that are too large for a file of the driver's go to a release."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = f"file://{os.path.dirname(os.path.abspath(target))}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared}/.{uuid.uuid4().hex}")
    store = folder.getFileSystem(conf)
    try:
        write_lines(df, folder.toString(), *order)
        names = (s.getPath().getName() for s in store.listStatus(folder))
        names = sorted((n for n in names if n.startswith("part-")), key=lambda n: (int(n.split("-")[1]), n))
        to = jvm.java.io.FileOutputStream(target, True)
        try:
            for name in names:
                part = store.open(jvm.org.apache.hadoop.fs.Path(folder, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, to, 1 << 16, False)
                finally:
                    part.close()
            to.getFD().sync()
        finally:
            to.close()
    finally:
        store.delete(folder, True)
