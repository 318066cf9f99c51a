"""Result rows as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import log_odds, percentage, share
from ..functions.text import exact_percentage, fixed

#: Contexts' names in file names and headers.
NAMES = {"CG": "CpG", "CHG": "CHG", "CHH": "CHH"}
SUFFIXES = {"standard": ".bedGraph", "fraction": ".meth.bedGraph", "counts": ".counts.bedGraph", "logit": ".logit.bedGraph", "methylkit": ".methylKit"}
DESCRIPTIONS = {"standard": "methylation levels", "fraction": "methylation fractions", "counts": "methylation counts", "logit": "logit transformed methylation fractions"}


def header(kind: str, prefix: str, ctx: str, merged: bool) -> str:
    if kind == "methylkit":
        return "chrBase\tchr\tbase\tstrand\tcoverage\tfreqC\tfreqT"
    return f'track type="bedGraph" description="{prefix} {NAMES[ctx]}{" merged" * merged} {DESCRIPTIONS[kind]}"'


def tabbed(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)).alias("value")


def log_odds_text(m: Column, u: Column) -> Column:
    return F.when(m + u == 0, "NaN").when(m == 0, "-inf").when(u == 0, "inf").otherwise(fixed(F.coalesce(log_odds(m, u), F.lit(0.0)), 6))


def site_lines(sites: DataFrame, kind: str) -> DataFrame:
    """value (a line) with rid and at, by which lines are sorted. sites has rid, chrom, s, e, m, u and, for methylkit, fwd."""
    m, u = F.col("m"), F.col("u")
    part = F.coalesce(share(m, u), F.lit(float("nan")))
    if kind == "standard":
        line = tabbed("chrom", "s", "e", percentage(m, u), "m", "u")
    elif kind == "fraction":
        line = tabbed("chrom", "s", "e", F.when(m + u == 0, "NaN").otherwise(fixed(part, 6)))
    elif kind == "counts":
        line = tabbed("chrom", "s", "e", m + u)
    elif kind == "logit":
        line = tabbed("chrom", "s", "e", log_odds_text(m, u))
    elif kind == "methylkit":
        line = tabbed(F.concat_ws(".", "chrom", F.col("e").cast("string")), "chrom", "e", F.when(F.col("fwd"), "F").otherwise("R"), m + u, fixed(part * 100, 2, 6), fixed((1 - part) * 100, 2, 6))
    else:
        raise ValueError(f"unknown format {kind}")
    return sites.select("rid", F.col("s").alias("at"), F.col("e").alias("upto"), line)


def report_lines(sites: DataFrame) -> DataFrame:
    """Lines of the cytosine report."""
    line = tabbed("chrom", F.col("pos") + 1, F.when(F.col("fwd"), "+").otherwise("-"), "m", "u", "ctx", "tri")
    return sites.select("rid", F.col("pos").alias("at"), F.col("pos").alias("upto"), line)


def mbias_lines(rows: DataFrame) -> DataFrame:
    return rows.select(tabbed("strand", "read", "position", "m", "u"))


def per_read_lines(rows: DataFrame) -> DataFrame:
    n = F.col("m") + F.col("u")
    text = F.when(n == 0, "0.0").otherwise(exact_percentage(F.col("m"), F.nullif(n, F.lit(0))))
    return rows.select("ord", tabbed("name", "chrom", "start", text, n))


def merged_lines(rows: DataFrame) -> DataFrame:
    return rows.select("chrom", "s", "e", "first", tabbed("chrom", "s", "e", percentage(F.col("m"), F.col("u")), "m", "u"))
