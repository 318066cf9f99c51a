"""Column functions of aligned reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bisulfite strands in their order of output.
STRANDS = ("OT", "OB", "CTOT", "CTOB")

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, SECOND, DUPLICATE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x80, 0x400


def masked(flag: Column, mask: int, value: int | None = None) -> Column:
    """Whether the bits of mask are as in value (all set, if there is none)."""
    return flag.bitwiseAND(mask) == (mask if value is None else value)


def bisulfite_strand(flag: Column, xg: Column) -> Column:
    """OT, OB, CTOT or CTOB of a read, from the genome that it was aligned to (XG) or else from its flags; null if neither
    tells, for pairs without a read number."""
    kind = F.substring(xg, 1, 1)
    second = masked(flag, 0x51, 0x51) | masked(flag, 0x91, 0x81)
    reverse = masked(flag, REVERSE)
    turned = F.when(masked(flag, 0x51, 0x41), False).when(second, True).when(masked(flag, 0x91), False).otherwise(reverse)
    return (
        F.when(kind == "C", F.when(turned, "CTOT").otherwise("OT"))
        .when(kind == "G", F.when(turned, "OB").otherwise("CTOB"))
        .when(masked(flag, PAIRED, 0), F.when(reverse, "OB").otherwise("OT"))
        .when(masked(flag, 0x50), "OB")
        .when(masked(flag, 0x40) | masked(flag, 0x90), "OT")
        .when(masked(flag, SECOND), "OB")
    )


def is_top(strand: Column) -> Column:
    return strand.isin("OT", "CTOT")


def strand_order(strand: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STRANDS)), strand)


def read_number(flag: Column) -> Column:
    return F.when(masked(flag, SECOND), 2).otherwise(1)


def methylated(top: Column, base: Column) -> Column:
    """Whether a base tells of methylation (true) or conversion (false); null if of neither."""
    return F.when(top, F.when(base == "C", True).when(base == "T", False)).otherwise(F.when(base == "G", True).when(base == "A", False))


def cigar_walk(cigar: Column, start: Column) -> Column:
    """A struct of a CIGAR string: blocks (arrays of q, r, n: bases from read place q on reference place r), gaps (r, n of
    deleted and skipped reference), qlen (read bases) and stop (end on the reference). Null for a malformed string."""
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0))
    # each told apart once, not for each field of a step
    ops = F.transform(ops, lambda op: F.struct(F.right(op, F.lit(1)).alias("kind"), F.substring(op, F.lit(1), F.length(op) - 1).cast("long").alias("n")))
    block = "struct<q:bigint,r:bigint,n:bigint>"
    none = F.expr(f"cast(array() as array<{block}>)")
    zero = F.struct(F.lit(0).cast("long").alias("q"), start.cast("long").alias("r"), none.alias("blocks"), none.alias("gaps"))

    def step(at: Column, op: Column) -> Column:
        kind, n = op["kind"], op["n"]
        here = F.array(F.struct(at["q"].alias("q"), at["r"].alias("r"), n.alias("n")))
        both, gap = kind.isin("M", "=", "X"), kind.isin("D", "N")
        return F.struct(
            F.when(both | kind.isin("I", "S"), at["q"] + n).otherwise(at["q"]).alias("q"),
            F.when(both | gap, at["r"] + n).otherwise(at["r"]).alias("r"),
            F.when(both, F.concat(at["blocks"], here)).otherwise(at["blocks"]).alias("blocks"),
            F.when(gap, F.concat(at["gaps"], here)).otherwise(at["gaps"]).alias("gaps"),
        )

    walked = F.aggregate(ops, zero, step, lambda s: F.struct(s["blocks"].alias("blocks"), s["gaps"].alias("gaps"), s["q"].alias("qlen"), s["r"].alias("stop")))
    # most reads are one block
    n, first = F.substring(cigar, F.lit(1), F.length(cigar) - 1).cast("long"), start.cast("long")
    alone = F.struct(F.array(F.struct(F.lit(0).cast("long").alias("q"), first.alias("r"), n.alias("n"))).alias("blocks"), none.alias("gaps"), n.alias("qlen"), (first + n).alias("stop"))
    malformed = cigar.rlike(r"[^0-9MIDNSHP=X]|(?:^|[MIDNSHP=X])[MIDNSHP=X]|[0-9]\z")
    return F.when(cigar.rlike(r"^[0-9]+M\z"), alone).when(~malformed, walked)


def within_bounds(strand: Column, read: Column, qpos: Column, length: Column, inclusion: dict[str, tuple[int, ...]], fixed: dict[str, tuple[int, ...]]) -> Column | None:
    """Whether a place in a read survives trimming: 1-based inclusive bounds (0: none) and numbers of bases cut from the
    ends, each as (read 1 left, right, read 2 left, right) by strand. None if nothing is trimmed."""
    keep = None
    for bounds, cut in ((inclusion, False), (fixed, True)):
        for name, (a, b, c, d) in bounds.items():
            for number, left, right in ((1, a, b), (2, c, d)):
                if cut:
                    ok = (qpos >= left) & (qpos < F.greatest(length - right, F.lit(0)))
                else:
                    ok = (qpos + 1 >= left) & (F.lit(right == 0) | (qpos + 1 <= right))
                if left or right:
                    ok = ~((strand == name) & (read == number)) | ok
                    keep = ok if keep is None else keep & ok
    return keep


def kept_span(strand: Column, read: Column, length: Column, inclusion: dict[str, tuple[int, ...]], fixed: dict[str, tuple[int, ...]]) -> tuple[Column, Column] | None:
    """The first place in a read that survives trimming by within_bounds(), and the end of those; None if nothing is trimmed."""
    starts, ends = [F.lit(0)], [length]
    for bounds, cut in ((inclusion, False), (fixed, True)):
        for name, (a, b, c, d) in bounds.items():
            for number, left, right in ((1, a, b), (2, c, d)):
                mine = (strand == name) & (read == number)
                if left:
                    starts.append(F.when(mine, left if cut else left - 1).otherwise(0))
                if right:
                    ends.append(F.when(mine, F.greatest(length - right, F.lit(0)) if cut else right).otherwise(length))
    if len(starts) == len(ends) == 1:
        return None
    return (F.greatest(*starts) if len(starts) > 1 else starts[0]), (F.least(*ends) if len(ends) > 1 else ends[0])
