"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes for or against a document or abstains. Expectation-maximisation over the counts of vote patterns finds how
often each rule gives each vote for good and for bad documents, and so how much its votes are worth; a document is kept if
its posterior probability of being good is a half or more. The patterns are 3 to the number of rules at most, whatever the
number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, words_col

SYMBOLS = r"[#*$%&|<>]"
RUN = 8
#: Common function words of the languages that the rules know.
FUNCTION_WORDS = "the of and to in is that for it as with by on are at this from or an be der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es de la le et les des en un une du que qui dans pour par sur au el los las del y se con una su al lo".split()
STEPS = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words lie in runs of RUN words that occur twice or more in the array. Runs are compared by digests; only
    arrays in which two agree are sorted."""

    def places(keys: Column) -> Column:
        def neighbours(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["k"] == e["k"], F.lit(False))
            return F.sort_array(F.transform(F.filter(F.transform(s, lambda e, j: F.struct(e["i"].alias("i"), (same(e, j - 1) | same(e, j + 1)).alias("r"))), lambda e: e["r"]), lambda e: e["i"]))

        return let(F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), neighbours)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(RUN), F.coalesce(F.get(p, j + 1) - x, F.lit(RUN)))), F.lit(0), lambda a, b: a + b)

    runs = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (RUN - 1)), lambda i: F.xxhash64(F.slice(h, i, RUN))))
    found = let(runs, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), let(places(k), covered)).otherwise(F.lit(0)))
    return F.when(F.size(words) <= RUN, F.lit(0)).otherwise(found).cast("long")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id and the numbers that the rules look at, all of whole texts (null: empty). No
    shuffle."""
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("t"))
    own = own.withColumn("w", words_col(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    dups = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n")))
    out = own.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        dups.alias("lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: x.isin(*sorted(set(FUNCTION_WORDS))))).cast("long").alias("n_function"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        let(F.col("w"), lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False))))).cast("long").alias("n_stutters"),
    )
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", F.col("lines.n").alias("n_lines"), "n_function", "n_capitals", "n_stutters")


def vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), F.lit(0)).when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes: 1 for, -1 against, 0 abstains."""
    part = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    word, symbol, dup = part("word_chars", "n_words"), part("n_symbols", "n_words"), part("n_dup_lines", "n_lines")
    repeat, function, capital = part("n_repeat_words", "n_words"), part("n_function", "n_words"), part("n_capitals", "word_chars")
    stutter = part("n_stutters", "n_words")
    return {
        "length": vote(F.col("n_words"), F.col("n_words") >= 50, F.col("n_words") < 20),
        "word_length": vote(word, (word >= 3) & (word <= 9), (word < 2) | (word > 12)),
        "symbols": vote(symbol, symbol <= 0.05, symbol > 0.15),
        "dup_lines": vote(dup, dup <= 0.1, dup > 0.3),
        "repeats": vote(repeat, repeat <= 0.1, repeat > 0.3),
        "function_words": vote(function, function >= 0.1, function < 0.03),
        "stutters": vote(stutter, stutter <= 0.03, stutter > 0.15),
        "capitals": vote(capital, capital <= 0.15, capital > 0.4),
    }


def log_odds(names: list[str], worth: dict[str, dict[int, float]], prior: float) -> Column:
    """The logarithm of the posterior odds of being good."""
    out = F.lit(prior)
    for n in names:
        w = worth[n]
        out = out + F.when(F.col(n) > 0, F.lit(w[1])).when(F.col(n) < 0, F.lit(w[-1])).otherwise(F.lit(w[0]))
    return out


def learned(patterns: DataFrame, names: list[str]) -> tuple[dict[str, dict[int, float]], float]:
    """From patterns (the votes and n, their number of documents): for each rule the log ratio of each vote's probability for
    good and for bad documents, and the log odds of a good one. The driver gets the table of patterns, which has 3 to the
    number of rules rows at most, in their order; expectation-maximisation begins from rules that are right more often than
    not."""
    rows = [(tuple(r[n] for n in names), r["n"]) for r in patterns.orderBy(*names).collect()]
    worth = [{1: math.log(0.8 / 0.4), 0: 0.0, -1: math.log(0.02 / 0.3)} for _ in names]
    prior = math.log(0.85 / 0.15)
    for _ in range(STEPS if rows else 0):
        sums = [{v: [1.0, 1.0] for v in (1, 0, -1)} for _ in names]  # a vote is never impossible; so a rule that never votes against can't decide alone
        good = bad = 0.0
        for votes, n in rows:
            p = 1 / (1 + math.exp(-(prior + sum(w[v] for w, v in zip(worth, votes)))))
            good, bad = good + n * p, bad + n * (1 - p)
            for s, v in zip(sums, votes):
                s[v][0] += n * p
                s[v][1] += n * (1 - p)
        was = prior
        worth = [{v: math.log(g / (good + 3)) - math.log(b / (bad + 3)) for v, (g, b) in s.items()} for s in sums]
        prior = math.log((good + 1) / (bad + 1))
        if abs(was - prior) < 1e-4:
            break
    return dict(zip(names, worth)), prior


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, the measures, the votes, posterior (the probability of being good), base_failed
    and kept. Null and wordless texts fail the base; repeated rows are judged and counted each; an empty table gives an
    empty one."""
    named = rules()
    votes = [F.coalesce(c, F.lit(0)).cast("int").alias(f"vote_{n}") for n, c in named.items()]
    names = [f"vote_{n}" for n in named]
    rows = settled(measured(docs, doc_id, text).select("*", *votes))
    worth, prior = learned(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), names)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rows.withColumn("posterior", 1 / (1 + F.exp(-log_odds(names, worth, prior)))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
