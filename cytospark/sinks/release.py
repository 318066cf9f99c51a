"""Outputs that change all at once, as folders of parts on any Hadoop file system.

Executors write each output's parts under a version of its own; the driver handles names and sizes, never their bytes. A version
counts once the pointer names it, and the pointer is replaced by one rename. So readers see all outputs of one version, and
whatever fails before leaves everything as it was. The version before stays for its readers; older ones go.

    folder/current                  the name of the version that counts
    folder/versions/NAME/manifest   its outputs: heads, parts and their bytes, in order
    folder/versions/NAME/OUTPUT/    an output's parts
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .files import write_lines


class Store:
    """A folder on the file system that its path names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.fs, conf = self.jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = folder.rstrip("/")
        self.system = self.path("").getFileSystem(conf)
        self.context = self.fs.FileContext.getFileContext(self.path("").toUri(), conf)

    def path(self, name: str):
        return self.fs.Path(posixpath.join(self.folder, name) if name else self.folder)

    def read(self, name: str) -> str | None:
        if not self.system.exists(self.path(name)):
            return None
        stream = self.system.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.system.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()

    def replace(self, source: str, target: str) -> None:
        """One rename, over what is there."""
        overwrite = self.jvm.java.lang.reflect.Array.newInstance(self.fs.Options.Rename.OVERWRITE.getClass(), 1)
        overwrite[0] = self.fs.Options.Rename.OVERWRITE
        self.context.rename(self.path(source), self.path(target), overwrite)

    def parts(self, name: str) -> list[tuple[str, int]]:
        """Names and bytes of an output's parts, in order."""
        found = ((s.getPath().getName(), s.getLen()) for s in self.system.listStatus(self.path(name)))
        return sorted((x for x in found if x[0].startswith("part-")), key=lambda x: (int(x[0].split("-")[1]), x[0]))

    def remove(self, name: str) -> None:
        self.system.delete(self.path(name), True)


class Release:
    """The outputs of one run under a folder, with the interface of files.Outputs; an output's name is the last part of its target."""

    def __init__(self, spark: SparkSession, folder: str):
        self.store, self.version = Store(spark, folder), uuid.uuid4().hex
        self.manifest: dict[str, dict] = {}

    def write(self, target: str, lines: Iterable[str], rows: DataFrame | None = None, order: tuple[str, ...] = ()) -> None:
        name = posixpath.basename(target)
        if name in self.manifest:
            raise ValueError(f"{name} is named twice")
        self.manifest[name] = {"head": list(lines), "parts": []}
        if rows is not None:
            where = f"versions/{self.version}/{name}"
            write_lines(rows, self.store.path(where).toString(), *order)
            self.manifest[name]["parts"] = self.store.parts(where)

    def commit(self) -> list[str]:
        before = self.store.read("current")
        self.store.write(f"versions/{self.version}/manifest", json.dumps(self.manifest))
        self.store.write(f"versions/{self.version}/pointer", self.version)
        self.store.replace(f"versions/{self.version}/pointer", "current")
        out = [f"{self.store.folder}/versions/{self.version}/{n}" for n in self.manifest]
        kept, self.manifest = {self.version, before}, {}
        for s in self.store.system.listStatus(self.store.path("versions")):
            if s.getPath().getName() not in kept and self.store.read(f"versions/{s.getPath().getName()}/manifest"):  # others may still be written
                self.store.remove(f"versions/{s.getPath().getName()}")
        return out

    def abandon(self) -> None:
        if self.manifest:
            self.store.remove(f"versions/{self.version}")
            self.manifest = {}

    def __enter__(self) -> Release:
        return self

    def __exit__(self, kind, *_) -> None:
        self.abandon()


def released(spark: SparkSession, folder: str) -> dict[str, tuple[list[str], DataFrame | None]]:
    """The outputs of the version that counts: for each its head and, if it has parts, their lines (value). A part that is missing or has
    other bytes than the manifest says is an error."""
    store = Store(spark, folder)
    version = store.read("current")
    if version is None:
        return {}
    out = {}
    for name, said in json.loads(store.read(f"versions/{version}/manifest") or "{}").items():
        where = f"versions/{version}/{name}"
        if said["parts"] and [list(x) for x in store.parts(where)] != said["parts"]:
            raise ValueError(f"{folder}: parts of {name} differ from the manifest")
        out[name] = (said["head"], spark.read.text(store.path(where).toString()) if said["parts"] else None)
    return out
