"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, and put together in another order.

A text's units are its lines. They become rows (one for each match, with its number and its length); a window's running sums of
lengths say where each unit ends. Each text asks for two cuts by the number of a unit; requests meet units by text and number, and
what they find adds up to two offsets for each text, by which it is cut. Texts themselves move once, in that last join; what
moves before are lengths, and copies of a text are one from the first shuffle on.

Everything is drawn by SHA-256 of a seed and the document's id, so a run can be repeated anywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import renamed, settled

#: A unit, matched from left to right.
UNIT = r"[^\n]*\n|[^\n]+"
#: What infilled() adds.
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Infill:
    """seed of the draws, the share of texts that are transformed and of those the share with the suffix first (in hundredths), and
    the marks before prefix, suffix and middle. A text with one of the marks stays plain, so that every output can be turned
    back."""

    seed: int = 7
    transformed: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if not (0 <= self.transformed <= 100 and 0 <= self.suffix_first <= 100):
            raise ValueError("shares are hundredths, from 0 to 100")
        if len({self.prefix, self.suffix, self.middle}) < 3 or not all(re.fullmatch(r"<[A-Za-z_|]+>", m) for m in self.marks):
            raise ValueError("marks must differ, and be letters in angle brackets")  # so no mark begins within another or between a text and a mark

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def unit_lengths(text: Column) -> Column:
    """The code points of each unit of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.length(u))


def drawn(doc_id: Column, seed: int, which: int) -> Column:
    """The number which (1 to 4) that is drawn for a document; a null id is drawn for as the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * which - 7, 8), 16, 10).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """32 bytes that rows share only if they agree in id and text."""
    return F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"), 256))


def cut_requests(rows: DataFrame, own: Infill) -> DataFrame:
    """key with found: the unit lengths, and after how many of them prefix and middle end (lo, hi); a row for each key. Copies
    are combined in the tasks before the shuffle."""
    n = F.size("lengths") + 1
    cuts = rows.select("key", "lengths", *(F.pmod(drawn(F.col("doc_id"), own.seed, k), n).cast("int").alias(f"cut_{k}") for k in (1, 2)))
    found = F.struct("lengths", F.least("cut_1", "cut_2").alias("lo"), F.greatest("cut_1", "cut_2").alias("hi"))
    return cuts.groupBy("key").agg(F.first(found).alias("found"))


def offsets(requests: DataFrame) -> DataFrame:
    """key, prefix_end and middle_end in code points, for texts of which one of them isn't 0. Units and requests lie side by side by
    key, so there is one shuffle; the unit's number is a condition of the join."""
    place = Window.partitionBy("key").orderBy("ordinal")
    units = requests.select("key", F.posexplode("found.lengths").alias("at", "length")).select("key", (F.col("at") + 1).alias("ordinal"), "length")
    units = units.select(F.col("key").alias("_key"), "ordinal", F.sum("length").over(place).alias("end"))
    asked = F.array(*(F.struct(F.lit(part).alias("part"), F.col(f"found.{c}").alias("cut")) for part, c in (("prefix", "lo"), ("middle", "hi"))))
    wanted = requests.select("key", F.explode(asked).alias("w")).select("key", "w.*")
    # as a range, since an equality would deal both sides out anew by key and number
    met = units.join(wanted, (F.col("_key") == F.col("key")) & (F.col("ordinal") >= F.col("cut")) & (F.col("ordinal") <= F.col("cut")))
    end = lambda part: F.coalesce(F.max(F.when(F.col("part") == part, F.col("end"))), F.lit(0)).cast("long")
    return met.groupBy("key").agg(end("prefix").alias("prefix_end"), end("middle").alias("middle_end"))


def joined(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column, own: Infill) -> Column:
    """A text's output."""
    psm = F.concat(F.lit(own.prefix), prefix, F.lit(own.suffix), suffix, F.lit(own.middle), middle)
    spm = F.concat(F.lit(own.suffix), suffix, F.lit(own.prefix), prefix, F.lit(own.middle), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column, own: Infill = Infill()) -> Column:
    """The text of an output, from that and its form alone."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        halves = lambda c, mark: F.split(c, rf"\Q{mark}\E", 2)
        head = halves(F.substring(output, F.lit(len(first) + 1), F.length(output)), second)
        tail = halves(head[1], own.middle)
        return head[0], tail[0], tail[1]

    prefix, suffix, middle = parts(own.prefix, own.suffix)
    suffix_, prefix_, middle_ = parts(own.suffix, own.prefix)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def infilled(docs: DataFrame, own: Infill = Infill(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and output. Columns
    of these names are replaced. A null text counts as empty, and an empty one is plain with an empty output; rows that agree
    in id and text get the same; a null id is drawn for as one document. An empty table gives an empty one."""
    names, (rows, name) = docs.columns, renamed(docs)
    body = F.coalesce(F.col(name[text]), F.lit(""))
    identity = F.col(name[doc_id])
    keyed = rows.select(row_key(identity, body).alias("key"), identity.alias("doc_id"), unit_lengths(body).alias("lengths"))
    found = settled(offsets(cut_requests(keyed, own)))
    marked = F.lit(False)
    for m in own.marks:
        marked |= F.contains(body, F.lit(m))
    plain = (body == "") | marked | (drawn(identity, own.seed, 3) % 100 >= own.transformed)
    form = F.when(plain, "plain").when(drawn(identity, own.seed, 4) % 100 < own.suffix_first, "spm").otherwise("psm")
    known = rows.select("*", body.alias("_text"), row_key(identity, body).alias("_key"), F.regexp_count(body, F.lit(UNIT)).cast("long").alias("_n"), form.alias("_form"))
    out = known.join(found, F.col("_key") == F.col("key"), "left")
    at, end = F.coalesce("prefix_end", F.lit(0)).cast("int"), F.coalesce("middle_end", F.lit(0)).cast("int")
    whole = F.length("_text")
    out = out.select("*", at.alias("_at"), (end - at).alias("_long"), F.substring("_text", F.lit(1), at).alias("_1"), F.substring("_text", at + 1, end - at).alias("_2"), F.substring("_text", end + 1, whole).alias("_3"))
    told = F.col("_form") != "plain"
    added = [F.col("_n"), F.col("_form"), F.when(told, F.col("_at").cast("long")), F.when(told, F.col("_long").cast("long")), joined(F.col("_form"), F.col("_1"), F.col("_2"), F.col("_3"), F.col("_text"), own)]
    kept = [F.col(name[c]).alias(c) for c in names if c not in ADDED]
    return out.select(*kept, *(c.alias(n) for c, n in zip(added, ADDED)))


def infill_report(docs: DataFrame, own: Infill = Infill(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of each row; cases as in infilled()."""
    rows = infilled(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), own)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"), own)).alias("restored_sha256"))
