"""Small alignments and a plain model of what they give."""

from __future__ import annotations

import random

CONTIGS = {"zeta": "ACGTCAGCTTCGANNCCGGACTGCCATCGCAGTAGCGCTACGTTGACCGGTCAGCATTGCG", "alpha": "CGCCAGGNATCGCTGACTTGCAAGCGTCCGA"}


def fasta(width: int = 7) -> str:
    out = []
    for name, seq in CONTIGS.items():
        out.append(f">{name} some words")
        mixed = "".join(c.lower() if i % 3 else c for i, c in enumerate(seq))
        out += [mixed[i : i + width] for i in range(0, len(mixed), width)]
    return "\n".join(out) + "\n"


def random_reads(n: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    names = list(CONTIGS)
    out = []
    for k in range(n):
        rid = rng.randrange(2)
        length = len(CONTIGS[names[rid]])
        ops, size = rng.choice([("{n}M", 0), ("3S{n}M", 3), ("4M2I{n}M", 6), ("4M3D{n}M", 4), ("2H4M2N{n}M1S", 5), ("5={n}X", 5)])
        body = rng.randrange(3, 12)
        cigar = ops.format(n=body)
        bases = body + size
        span = body + {"{n}M": 0, "3S{n}M": 0, "4M2I{n}M": 4, "4M3D{n}M": 7, "2H4M2N{n}M1S": 6, "5={n}X": 5}[ops]
        start = rng.randrange(0, length - span + 1)
        flag = rng.choice([0, 16, 99, 147, 83, 163, 99, 147, 83, 163, 1024, 73, 65, 4])
        out.append({"name": f"f{rng.randrange(n // 2)}", "flag": flag, "rid": rid, "start": start, "mapq": rng.choice([60, 60, 60, 9]), "cigar": cigar, "bases": "".join(rng.choice("ACGTTCAGN") for _ in range(bases)), "quals": [rng.randrange(0, 41) for _ in range(bases)], "xg": rng.choice([None, "CT", "GA"]), "nh": rng.choice([None, 1, 1, 2])})
    return sorted(out, key=lambda r: (r["rid"], r["start"]))


def sam(reads: list[dict]) -> str:
    names = list(CONTIGS)
    out = ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{n}\tLN:{len(s)}" for n, s in CONTIGS.items())]
    for r in reads:
        tags = ([f"XG:Z:{r['xg']}"] if r["xg"] else []) + ([f"NH:i:{r['nh']}"] if r["nh"] is not None else [])
        quals = "".join(chr(33 + q) for q in r["quals"]) if r["quals"] is not None else "*"
        out.append("\t".join([r["name"], str(r["flag"]), names[r["rid"]], str(r["start"] + 1), str(r["mapq"]), r["cigar"], "*", "0", "0", r["bases"], quals, *tags]))
    return "\n".join(out) + "\n"


def strand_of(flag: int, xg: str | None) -> str:
    if xg and xg[0] in "CG":
        own = {"C": ("OT", "CTOT"), "G": ("CTOB", "OB")}[xg[0]]
        if flag & 0x51 == 0x41:
            return own[0]
        if flag & 0x51 == 0x51 or flag & 0x91 == 0x81:
            return own[1]
        if flag & 0x91 == 0x91:
            return own[0]
        return own[1] if flag & 0x10 else own[0]
    if not flag & 1:
        return "OB" if flag & 0x10 else "OT"
    if flag & 0x50 == 0x50:
        return "OB"
    if flag & 0x40 or flag & 0x90 == 0x90:
        return "OT"
    return "OB"


def context_of(seq: str, at: int) -> tuple[bool, str, str] | None:
    pair = {"A": "T", "C": "G", "G": "C", "T": "A"}
    base = seq[at]
    if base not in "CG":
        return None
    near = [seq[i] if 0 <= i < len(seq) else "N" for i in ((at + 1, at + 2) if base == "C" else (at - 1, at - 2))]
    if base == "G":
        near = [pair.get(c, "N") for c in near]
    near = [c if c in "ACGT" else "N" for c in near]
    return base == "C", "CG" if near[0] == "G" else "CHG" if near[1] == "G" else "CHH", "C" + "".join(near)


def passes(r: dict) -> bool:
    f = r["flag"]
    return not f & 4 and r["mapq"] >= 10 and not f & 0xF00 and f & 9 != 9 and f & 3 != 1 and (r["nh"] or 0) <= 1


def bases_of(r: dict) -> list[tuple[int, int, str, int]]:
    """(read place, reference place, base, quality)."""
    q, p, out, n = 0, r["start"], [], ""
    for c in r["cigar"]:
        if c.isdigit():
            n += c
            continue
        k, n = int(n), ""
        if c in "M=X":
            out += [(q + i, p + i, r["bases"][q + i], 255 if r["quals"] is None else r["quals"][q + i]) for i in range(k)]
        q += k if c in "M=XIS" else 0
        p += k if c in "M=XDN" else 0
    return out


def adjust(one: tuple, two: tuple) -> tuple[int, int]:
    """New qualities of two bases (top, base, quality) of one fragment."""
    (t1, b1, q1), (t2, b2, q2) = one, two
    if t1 != t2:
        return q1, q2
    if b1 == b2:
        return (min(255, q1 + q1 // 5), 0) if q1 > q2 else (0, min(255, q2 + q2 // 5))
    if q1 > q2 and b1 != "N":
        return q1 - q2, 0
    if q2 > q1 and b2 != "N":
        return 0, q2 - q1
    return 0, 0


def model(reads: list[dict], quality: int = 5) -> dict[tuple[int, int], dict]:
    """(rid, place) of each covered cytosine to its counts."""
    columns: dict[tuple[int, int], list] = {}
    for r in reads:
        if passes(r):
            top = strand_of(r["flag"], r["xg"]) in ("OT", "CTOT")
            for _, p, b, q in bases_of(r):
                columns.setdefault((r["rid"], p), []).append([r["name"], r["flag"] & 9 == 1, top, b, q])
    out = {}
    for (rid, p), col in columns.items():
        found = context_of(list(CONTIGS.values())[rid], p)
        waiting: dict[str, list] = {}
        for e in col:
            if e[1]:
                if other := waiting.pop(e[0], None):
                    other[4], e[4] = adjust(tuple(other[2:]), tuple(e[2:]))
                else:
                    waiting[e[0]] = e
        if found:
            fwd, ctx, _ = found
            good = [e for e in col if e[4] >= quality]
            own, far = [e[3] for e in good if e[2] == fwd], [e[3] for e in good if e[2] != fwd and e[3] != "N"]
            out[rid, p] = {"fwd": fwd, "ctx": ctx, "m": own.count("C" if fwd else "G"), "u": own.count("T" if fwd else "A"), "opposite": len(far), "variant": sum(b != ("C" if fwd else "G") for b in far)}
    return out
