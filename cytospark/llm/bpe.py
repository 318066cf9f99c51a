"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text there is one token that can come last in the prefix's encoding: the token t,
ending there, for which t can follow the last token of the prefix before it. Two tokens can follow one another if the
merges, run on their joined bytes, give back the two. So one pass over the prefixes gives a table of last tokens, and
following it from the end gives the encoding. The table of a prefix never depends on what comes after it: an append
only adds entries, and an edit changes entries from its place on until the old ones fit again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrowed, columns, slices, with_fields

#: Chunks of text, prefixes and pairs of tokens that a worker remembers at most.
CHUNKS, PREFIXES, PAIRS = 300_000, 800_000, 800_000
#: Bytes up to which the prefixes of a piece are remembered beyond the piece.
SHORT = 48


class PrefixEncoder:
    """Encodes with a rank file (base64 token and rank in each line); a token's rank is its id."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        # \s of Python's modules also has U+001C to U+001F, which are not white space in Unicode
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # Chunks are whole numbers of pieces of this pattern family: one blank at most, then no white space; or white space
        self.chunk = re.compile(r" ?\S+|\s+(?!\S)|\s+") if pattern == public_tokenizers.PATTERN else None
        self.odd = re.compile("[\x1c-\x1f]")
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.prefixes: dict[bytes, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: again and again the lowest-ranked neighbours merge. Only for one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            least = min(ranked)
            if least == 1 << 60:
                break
            i = ranked.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether b can come right after a; a = -1 is the start, where b only has to be what its own bytes give."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.merged(self.tokens[b]) == [b] if a < 0 else self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        self.pairs[a << 32 | b] = known
        return known

    def last_token(self, data: bytes, end: int, table: list[int]) -> int:
        """The last token of data[:end]; table has those of the shorter prefixes (table[0] is -1)."""
        ranks, pairs = self.ranks, self.pairs
        for start in range(end - self.longest if end > self.longest else 0, end):
            if (part := data[start:end]) in ranks:
                token = ranks[part]
                ok = pairs.get(table[start] << 32 | token)
                if ok or ok is None and self.follows(table[start], token):
                    return token
        raise ValueError("a byte has no token")

    def last(self, prefix: bytes) -> int:
        """The last token of a short prefix, remembered for all pieces that begin with it; what it needs of shorter ones
        is found the same way."""
        ranks, pairs, known = self.ranks, self.pairs, self.prefixes
        for start in range(len(prefix)):
            if (part := prefix[start:]) in ranks:
                token = ranks[part]
                before = -1
                if start and (before := known.get(prefix[:start], -1)) < 0:
                    before = self.last(prefix[:start])
                ok = pairs.get(before << 32 | token)
                if ok or ok is None and self.follows(before, token):
                    known[prefix] = token
                    return token
        raise ValueError("a byte has no token")

    def extend(self, table: list[int], data: bytes) -> list[int]:
        """Adds to the table of a prefix of data the entries of all of data."""
        for end in range(len(table), len(data) + 1):
            table.append(self.last_token(data, end, table))
        return table

    def table(self, data: bytes) -> list[int]:
        return self.extend([-1], data)

    def edited(self, table: list[int], data: bytes, start: int, stop: int, new: bytes) -> tuple[list[int], bytes]:
        """The table and the bytes after data[start:stop] became new. Entries behind the edit are computed only until as
        many in a row as the longest token has bytes equal the old ones; from there on all do."""
        after = data[:start] + new + data[stop:]
        out, shift, same = table[: start + 1], len(new) - (stop - start), 0
        for end in range(start + 1, len(after) + 1):
            out.append(self.last_token(after, end, out))
            same = same + 1 if end - shift > stop and out[end] == table[end - shift] else 0
            if same >= self.longest:
                return out + table[end - shift + 1 :], after
        return out, after

    def walk(self, table: list[int]) -> list[int]:
        """The encoding that a table holds."""
        out, end = [], len(table) - 1
        while end > 0:
            out.append(table[end])
            end -= len(self.tokens[table[end]])
        return out[::-1]

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        if data in self.ranks:
            return (self.ranks[data],)
        if len(data) > SHORT:
            return tuple(self.walk(self.table(data)))
        if len(self.prefixes) >= PREFIXES:
            self.prefixes.clear()
        out, known, tokens = [], self.prefixes, self.tokens
        while data:
            token = known.get(data, -1)
            if token < 0:
                token = self.last(data)
            out.append(token)
            data = data[: -len(tokens[token])]
        return tuple(out[::-1])

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        body = chunk[1:] if chunk[0] == " " else chunk
        if body.isascii() and body.isalpha():  # the commonest case of the pattern
            ids = self.encode_piece(chunk)
        else:
            ids = tuple(chain.from_iterable(map(self.encode_piece, self.pieces(chunk))))
        if len(chunk) <= SHORT:
            if len(self.known) >= CHUNKS:
                self.known.clear()
            self.known[chunk] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if self.chunk is None or self.odd.search(text):
            return list(chain.from_iterable(map(self.encode_piece, self.pieces(text))))
        encode = self.encode_chunk
        return list(chain.from_iterable([self.known.get(c) or encode(c) for c in self.chunk.findall(text)]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def appended(self, text: str, ids: list[int], suffix: str) -> list[int]:
        """The encoding of text + suffix from that of text: all pieces but the last two stay, as a piece depends on at most
        the run of characters that it is in and the one after it."""
        kept = self.pieces(text[-4096:])[-2:] if len(text) > 4096 else self.pieces(text)[-2:]
        tail = "".join(kept)
        if len(tail) >= 4096 - 1 and len(text) > 4096 or not text:
            return self.encode(text + suffix)
        drop = sum(len(self.encode_piece(p)) for p in kept)
        return ids[: len(ids) - drop] + self.encode(tail + suffix)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> PrefixEncoder:
    """One encoder for each worker and rank file."""
    return PrefixEncoder(path, pattern)


def encode_documents(docs: DataFrame, ranks: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column ids (array<int>): the encoding of the whole text, each match of the pattern by itself. A null
    or empty text has no ids. Other columns stay; a column called like ids is replaced. No shuffle."""
    rest = [c for c in docs.columns if c != ids]
    schema = with_fields(docs, rest, f"`{ids}` array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in slices(batches):
            found = pa.array([enc.encode(t or "") for (t,) in columns(batch, text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, ids])

    return arrowed(docs.select(rest), run, schema)


def decode_documents(docs: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the column out (binary): the bytes that the ids stand for; null ids give no bytes."""
    rest = [c for c in docs.columns if c != out]
    schema = with_fields(docs, rest, f"`{out}` binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in slices(batches):
            found = pa.array([enc.decode(x or ()) for (x,) in columns(batch, ids)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    return arrowed(docs.select(rest), run, schema)


def append_documents(docs: DataFrame, ranks: str, text: str = "text", ids: str = "ids", suffix: str = "suffix") -> DataFrame:
    """docs with ids brought up to date for text + suffix; only the end of each text is encoded again. Nulls count as empty."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in slices(batches):
            found = pa.array([enc.appended(t or "", list(x or ()), s or "") for t, x, s in columns(batch, text, ids, suffix)], pa.list_(pa.int32()))
            at = batch.schema.get_field_index(ids)
            yield batch.set_column(at, pa.field(ids, found.type), found)

    return arrowed(docs, run, schema)


def encode_digests(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by blanks) and decoded_sha256 (of the bytes
    decoded from the ids). A null text counts as empty; repeated rows each give a row. Ids never leave their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in slices(batches):
            n, coded, decoded = [], [], []
            for (t,) in columns(batch, text):
                ids = enc.encode(t or "")
                n.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrowed(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias(text)), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
