"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A list has URLs to block, in any spelling; a listed URL stands for itself and for what lies beneath it. A page's URL can only
meet entries made of one of its host's suffixes and of its path, with the query or without, or one of the path's
directories, so it has a few possible entries. Those that the Bloom filter passes meet the list in a hash join, which
removes the false hits.

Rules, which name a host and a path prefix as they are written, go before the list: they meet the URLs in the same way,
and the longest that fits decides.

The canonical form of a URL is its host, port and path with the query: without scheme, user, fragment and the port that
is the scheme's own, and without tabs, line ends and blanks around it; the host in lower case without dots at its end; in
the path no dot segments, and "/" for none; escapes of letters, digits and -._~ undone, others in upper case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import arrowed, columns, settled, slices

#: Ports that go without saying (fixed values).
PORTS = {"http": "80", "https": "443", "ftp": "21"}
_parts = re.compile(r"(?s)([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?")
_escape = re.compile(r"%([0-9A-Fa-f]{2})")


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if c.isascii() and (c.isalnum() or c in "-._~") else m[0].upper()

    return _escape.sub(one, text)


def canonical(url: str | None) -> tuple[str, str, str] | None:
    """Host (with a port of its own), path and query (with its ?, or empty) of a URL in the canonical form; None without a scheme or
    a host."""
    m = _parts.match(re.sub(r"[\t\r\n]", "", url).strip(" ")) if url else None
    if not m:
        return None
    host, _, port = m[2].rpartition("@")[2].lower().partition(":") if "[" not in m[2] else (m[2].lower(), "", "")
    host = unescaped(host).lower().rstrip(".")
    if not host:
        return None
    out: list[str] = []
    for part in (names := unescaped(m[3]).split("/")[1:]):
        if part == "..":
            del out[-1:]
        elif part != ".":
            out.append(part)
    path = "/" + "/".join(out) + ("/" if out and names[-1] in (".", "..") else "")
    return host + (f":{port}" if port and port != PORTS.get(m[1].lower()) else ""), path, unescaped(m[4] or "")


def entries(url: str | None, labels: int) -> list[str]:
    """The entries that a URL can meet, for a list whose hosts have so many labels at most."""
    found = canonical(url)
    if not found:
        return []
    host, path, query = found
    names = host.split(".")
    cuts = [path[: i + 1] for i, c in enumerate(path) if c == "/"]
    paths = dict.fromkeys([path + query, path, *cuts])
    return [".".join(names[i:]) + p for i in range(max(0, len(names) - labels), len(names)) for p in paths]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def digests(hosts: list[str], paths: list[str]) -> np.ndarray:
    """Of possible entries: a blank stands in no host, so host and path can't run together."""
    return np.fromiter((xxhash.xxh3_64_intdigest(f"{a} {b}") for a, b in zip(hosts, paths)), np.uint64, len(hosts))


def listed_digests(listed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = digests(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return arrowed(listed.select("host", "path"), run, "h long")


def canonical_entries(listed: DataFrame, url: str = "url") -> DataFrame:
    """entry and labels (of its host) of each listed URL that has a canonical form, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for (u,) in columns(batch, "url") if (x := canonical(u))]
            yield pa.RecordBatch.from_arrays([pa.array(["".join(x) for x in found], pa.string()), pa.array([x[0].count(".") + 1 for x in found], pa.int32())], names=["entry", "labels"])

    return arrowed(listed.select(listed[url].alias("url")), run, "entry string, labels int").distinct()


def listed_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct URLs (url) that meet an entry of listed (url)."""
    own = settled(canonical_entries(listed))
    size = own.agg(F.count(F.lit(1)).alias("n"), F.max("labels").alias("labels")).first()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([xxhash.xxh3_64_intdigest(e) for (e,) in columns(batch, "entry")], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    words = urls.sparkSession.sparkContext.broadcast(bloom.build(arrowed(own.select("entry"), hashed, "h long"), size["n"]))
    labels = size["labels"] or 0

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(u, e) for (u,) in columns(batch, "url") for e in entries(u, labels)]
            hit = np.flatnonzero(bloom.passes(words.value, np.array([xxhash.xxh3_64_intdigest(e) for _, e in found], np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array([found[i][k] for i in hit], pa.string()) for k in (0, 1)], names=["url", "entry"])

    hits = arrowed(urls.select("url").where("url is not null"), possible, "url string, entry string")
    return hits.join(own.select("entry"), "entry", "left_semi").select("url").distinct()  # exact


def filter_urls(pages: DataFrame, listed: DataFrame, default: str = "allow", url: str = "url", blocked: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict. listed has the rules' host, path and verdict; a rule fits its host and all of its
    subdomains if the URL's path starts with its path. The longest rule that fits (by characters, then block before
    allow) gives rule (host and path) and verdict. Without one, rule is null and verdict is block if the URL meets an entry of
    blocked (url), or else default. An empty path in a rule fits every path. Columns of these names are replaced; null and
    malformed URLs and repeated rows keep their rows; those without a canonical form meet no entry, and entries without one
    are passed over."""
    if blocked is not None:
        found = listed_urls(pages.select(pages[url].alias("url")), blocked).select(F.col("url").alias("_listed"))
        marked = filter_urls(pages.withColumn("_own", pages[url]), listed, default, url).join(found, F.col("_own") == F.col("_listed"), "left")
        verdict = F.when(F.col("rule").isNull() & F.col("_listed").isNotNull(), "block").otherwise(F.col("verdict"))
        return marked.withColumn("verdict", verdict).drop("_own", "_listed")
    spark = pages.sparkSession
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(pages[url])
    parted = pages.select(*rest, host.alias("host"), path.alias("path"))
    listed = listed.where("host is not null and path is not null").select(F.concat("host", "path").alias("rule"), "host", "path", "verdict")
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    words = spark.sparkContext.broadcast(bloom.build(listed_digests(listed), size["n"]))
    lengths, labels = list(size["lengths"]), size["labels"] or 0  # path lengths in the list; a URL has few of them

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, hosts, paths = [], [], []
            for h, p in columns(batch, "host", "path"):
                parts = h.split(".")
                for name in (".".join(parts[i:]) for i in range(max(0, len(parts) - labels), len(parts))):
                    for n in lengths:
                        if n > len(p):
                            break
                        owner.append((h, p))
                        hosts.append(name)
                        paths.append(p[:n])
            hit = np.flatnonzero(bloom.passes(words.value, digests(hosts, paths)))
            arrays = [[owner[i][0] for i in hit], [owner[i][1] for i in hit], [hosts[i] for i in hit], [paths[i] for i in hit]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in arrays], names=["_host", "_path", "host", "path"])

    hits = arrowed(parted.select("host", "path").where("host <> ''"), possible, "_host string, _path string, host string, path string")
    hits = hits.join(listed, ["host", "path"])  # exact
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), F.col("rule"), F.col("verdict"))).alias("_best")
    fits = hits.groupBy("_host", "_path").agg(best)
    joined = parted.join(fits, (parted["host"] == fits["_host"]) & (parted["path"] == fits["_path"]), "left")
    return joined.select(*rest, parted["host"], parted["path"], F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
