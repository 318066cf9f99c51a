"""Secret scans: plain patterns in every text, and weak candidates by multipart credential linking.

A long random-looking string, an account name or an address alone is no secret. Within one scope (a paragraph of one
document) they are: a weak secret counts if an access identifier stands near, and account names and addresses count if
they stand near such a secret. Near means an interval join: parts meet in bins of the reach's width, then by distance.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import arrowed, columns, renamed, settled, slices, with_fields

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The order of kinds at equal starts.
KINDS = ("assign", "access", "hex", "weak_secret", "account", "endpoint")
WEAK = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])")
ACCOUNT = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}""", re.I | re.A)
#: What follows an address's scheme, what a scheme may hold, and an address without one.
AFTER_SCHEME, SCHEME = re.compile(r"""://[^\s"'<>]+"""), frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
HOST = re.compile(r"(?<![A-Za-z0-9.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++:[0-9]{2,5}(?![0-9])")
SCOPE = re.compile(r"\n[\x20\t\r]*\n")
#: Code points between two parts of one credential at most.
REACH = 240


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The plain spans. For access and hex the length can stand in the pattern, as both match whole runs; for assign not,
    as a match that is too short still takes its characters."""
    return [
        *(("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6),
        *(("access", m.start(), m.end()) for m in ACCESS.finditer(text)),
        *(("hex", m.start(), m.end()) for m in HEX.finditer(text)),
    ]


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses: from the first letter of a scheme on, found by going back from its end, so that a long run of letters is looked at
    once; and hosts with ports outside of those."""
    urls, end, mark = [], 0, text.find("://")
    while mark >= 0:
        at = mark
        while at > end and text[at - 1] in SCHEME:
            at -= 1
        while at < mark and not text[at].isalpha():
            at += 1
        m = AFTER_SCHEME.match(text, mark) if at < mark else None
        if m:
            urls.append((at, end := m.end()))
        mark = text.find("://", max(end, mark + 1))
    return sorted(urls + [m.span() for m in HOST.finditer(text) if not overlapped(urls, *m.span())])


def overlapped(spans: list[tuple[int, int]], start: int, stop: int) -> bool:
    """Whether one of spans, which are in order and don't overlap one another, overlaps this one."""
    k = bisect_left(spans, (stop,))
    return k > 0 and spans[k - 1][1] > start


def joint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """What may be part of a credential, with its scope's number: weak secrets outside the plain spans, access identifiers,
    account names and addresses. Nothing for texts without a weak secret."""
    weak, plain = [], joint([(a, b) for _, a, b in base])
    for m in WEAK.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and s.lower() != s and s.upper() != s and not overlapped(plain, *m.span()):
            weak.append(("weak_secret", m.start(), m.end()))
    if not weak:
        return []
    parts = weak + [x for x in base if x[0] == "access"]
    parts += [("account", m.start(), m.end()) for m in ACCOUNT.finditer(text)]
    parts += [("endpoint", a, b) for a, b in endpoints(text)]
    cuts, out, scope = [m.end() for m in SCOPE.finditer(text)], [], 0
    for kind, a, b in sorted(parts, key=lambda x: x[1]):
        while scope < len(cuts) and cuts[scope] <= a:
            scope += 1
        out.append((kind, a, b, scope))
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def near(left: DataFrame, right: DataFrame, reach: int = REACH) -> DataFrame:
    """Rows of left with a row of right in the same text and scope, at most reach code points away: an interval semi-join on
    bins of the reach's width. No pair leaves the join, and a bin holds no more parts than its characters."""
    a = left.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("stop") + reach) / reach))))
    b = right.select(*(F.col(c).alias(f"_{c}") for c in ("text_key", "scope", "start", "stop")), F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("stop") / reach))).alias("_there"))
    on = (F.col("text_key") == F.col("_text_key")) & (F.col("scope") == F.col("_scope")) & (F.col("_bin") == F.col("_there"))
    on &= (F.col("start") - F.col("_stop") <= reach) & (F.col("_start") - F.col("stop") <= reach)
    return a.join(b, on, "left_semi").drop("_bin").distinct()


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The parts (text_key, kind, start, stop, scope) that make up credentials."""
    secrets = parts.where("kind = 'weak_secret'")
    named = near(secrets, parts.where("kind in ('access', 'account')"), reach)
    beside = near(parts.where("kind in ('account', 'endpoint')"), named, reach)
    return named.unionByName(beside)


SPAN = "struct<kind:string,start:int,stop:int>"


def _found(docs: DataFrame, text: str, keep: list[str], side: tuple[np.ndarray, bool] | None = None) -> DataFrame:
    """The columns of keep with base, text_key (null without a weak secret) and parts of each text; with a side, only of the texts
    whose _h passes the filter, or only of the others. No shuffle."""
    schema = with_fields(docs, keep, f"base array<{SPAN}>, text_key string, parts array<struct<kind:string,start:int,stop:int,scope:int>>")
    span = [("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]
    sent = docs.sparkSession.sparkContext.broadcast(side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if sent.value:
                words, inside = sent.value
                batch = batch.filter(pa.array(bloom.holds(words, batch.column(batch.schema.get_field_index("_h"))) == inside, pa.bool_()))
            base, keys, parts = [], [], []
            for (t,) in columns(batch, "_text"):
                found = base_spans(t or "")
                weak = weak_parts(t or "", found)
                base.append([dict(zip(("kind", "start", "stop"), x)) for x in in_order(found)])
                keys.append(xxhash.xxh3_128_hexdigest(t.encode("utf-8", "surrogatepass")) if weak else None)
                parts.append([dict(zip(("kind", "start", "stop", "scope"), x)) for x in weak])
            arrays = [pa.array(base, pa.list_(pa.struct(span))), pa.array(keys, pa.string()), pa.array(parts, pa.list_(pa.struct([*span, ("scope", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *arrays], names=[*keep, "base", "text_key", "parts"])

    return arrowed(docs.select(*keep, F.xxhash64(docs[text]).alias("_h"), docs[text].alias("_text")), run, schema)


def _links(parts: DataFrame) -> DataFrame:
    """text_key and more: the spans that linking adds to a text."""
    parts = parts.where("text_key is not null").select("text_key", F.explode("parts").alias("p")).select("text_key", "p.*").distinct()
    return settled(linked(parts).groupBy("text_key").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("more")))


def _ordered(found: DataFrame, keep: list[str], more: Column) -> DataFrame:
    """The columns of keep, base and spans, which are base and more in order."""
    order = F.array(*map(F.lit, KINDS))
    ranked = F.transform(F.concat("base", more), lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("k"), x["stop"].alias("stop"), x["kind"].alias("kind")))
    spans = F.transform(F.array_sort(ranked), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return found.select(*keep, "base", spans.alias("spans"))


def _joined(some: DataFrame, others: DataFrame, links: DataFrame, keep: list[str]) -> DataFrame:
    """Both with their spans. Only some meets the links, so what has none moves nowhere."""
    none = F.array().cast(f"array<{SPAN}>")
    met = some.join(links, "text_key", "left")
    return _ordered(met, keep, F.coalesce("more", none)).unionByName(_ordered(others, keep, none))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base and spans: arrays of (kind, start, stop) in order, offsets in code points. A null or empty text has
    none. Columns of these names are replaced. Equal texts get equal spans, so repeated rows and equal or null ids do no
    harm. Only texts with a weak secret take part in the joins, and only those with a linked one (and a few more, which a
    Bloom filter lets through) are moved."""
    keep = [c for c in docs.columns if c not in ("base", "spans", "text_key", "parts", "_h")]
    marked = docs.select(docs[text].alias("text"), F.xxhash64(docs[text]).alias("hash"))
    parts = settled(_found(marked, "text", ["hash"]).where("text_key is not null").select("hash", "text_key", "parts"))
    links = _links(parts)
    wanted = settled(parts.join(links.select("text_key"), "text_key", "left_semi").select("hash").distinct())
    words = bloom.build(wanted, wanted.count())
    return _joined(_found(docs, text, keep, (words, True)), _found(docs, text, keep, (words, False)), links, keep)


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs, in which each span found in text is replaced by mask (spans that overlap, by one); n_chars, if there is one,
    is counted anew. No document is dropped; nulls stay."""
    names, (docs, name) = docs.columns, renamed(docs)
    length, text = name.get("n_chars"), name[text]
    found = scan(docs, text)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index(text)
            out = []
            for t, spans in columns(batch, text, "spans"):
                if spans:
                    parts, end = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
                        if s["start"] >= end:
                            parts += [t[end : s["start"]], mask]
                        end = max(end, s["stop"])
                    t = "".join(parts) + t[end:]
                out.append(t)
            batch = batch.set_column(at, pa.field(text, pa.string()), pa.array(out, pa.string()))
            yield batch.select(schema.names)

    out = arrowed(found, run, schema)
    out = out.withColumn(length, F.length(text).cast(schema[length].dataType)) if length else out
    return out.toDF(*names)


def span_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:stop, joined by commas). Texts are
    read once; only ids and spans go on."""
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias(text))
    found = settled(_found(docs, text, ["doc_id"]))
    found = _joined(found.where("text_key is not null"), found.where("text_key is null"), _links(found), ["doc_id"])
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"))
