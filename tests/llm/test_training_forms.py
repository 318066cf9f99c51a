"""Fill-in-the-middle, the prefix trie and the quality classifier."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytospark.llm import infill, prefix_trie, quality_classifier, queries

from .test_operators import DOCS, edge_texts, empty, frame, prose, shuffled

SF = "/root/testdata/sf0.01"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

# 11 fill-in-the-middle


def plainly_infilled(doc_id, text, seed=7, transformed=100, suffix_first=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or c % 100 >= transformed:
        return n, "plain", None, None, text or ""
    if d % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    odd = ["\n", "\n\n\n", "a\nb\n", "a\n\nb", "x <P> y\nz", "ends with <", "<S\n<S\n<M\n<P", "été\n日本\n\U0001f600\n", "\r\nx\r\n", "<M><S>", "line\n" * 3000]
    return edge_texts() + odd + ["\n".join(prose(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 12))) for _ in range(60)]


@pytest.mark.parametrize("transformed, suffix_first", [(100, 50), (40, 0), (70, 100)])
def test_infill_against_plain_code(spark, texts, transformed, suffix_first):
    own = infill.Infill(transformed=transformed, suffix_first=suffix_first)
    got = {r["doc_id"]: r for r in infill.infilled(shuffled(spark, texts), own).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in infill.ADDED) == plainly_infilled(i, t, 7, transformed, suffix_first)
        assert (got[i]["text"], got[i]["lang"]) == (t, "en")
    forms = collections.Counter(r["form"] for r in got.values())
    assert len(forms) == (3 if (transformed, suffix_first) == (100, 50) else 2)


def test_infill_is_turned_back(spark, texts):
    rows = infill.infill_report(shuffled(spark, texts)).collect()
    assert {r["doc_id"]: r["restored_sha256"] for r in rows} == {i: sha(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["output_sha256"] for r in rows} == {i: sha(plainly_infilled(i, t)[4]) for i, t in enumerate(texts)}


def test_infill_of_odd_rows(spark):
    extra = [(0, "a\nb\nc\n", None, None, None)] * 300 + [(0, "other\ntext\n", None, None, None), (None, "a\nb\nc\n", None, None, None), (None, None, None, None, None)]
    docs = frame(spark, ["a\nb\nc\n", None], extra).withColumn("key", F.lit("clash")).withColumn("_key", F.lit(1)).withColumn("output", F.lit("clash"))
    got = infill.infilled(docs)
    assert got.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "key", "_key", *infill.ADDED]
    want = [(i, t, plainly_infilled(i, t)) for i, t in [(0, "a\nb\nc\n"), (1, None), *(r[:2] for r in extra)]]
    found = [(r["doc_id"], r["text"], tuple(r[c] for c in infill.ADDED)) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert infill.infill_report(empty(spark)).count() == 0


def test_infill_moves_texts_once(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = infill.infilled(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan


def test_marks_must_differ():
    for wrong in ({"prefix": "<S>"}, {"middle": "x"}, {"seed": 1, "transformed": 101}):
        with pytest.raises(ValueError):
            infill.Infill(**wrong)


# 12 prefix trie

TURNS = "conv_id long, turn long, role string, text string"


def plainly_rebuilt(rows, group=20, heads=4):
    """The turns (role, text) of each conversation."""
    digest = lambda r: hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest()[:16]
    own = collections.defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        own[r[0]].append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = tuple(own.get(c - (abs(c) % group) * (1 if c >= 0 else -1), [])[:h] + turns[h:])
    return out


def plain_trie(paths):
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words(p)
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if paths[c] == p)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(ends(p))) for p, m in members.items())


def found_trie(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", *prefix_trie.SUMS, "ends_sha256").collect())


def conversations(rng, n, turns=4, choice=3):
    """Many that begin alike, some with nulls, equal turns and repeated rows."""
    rows = []
    for c in rng.sample(range(-40, 4 * n), n):
        for t in range(rng.randrange(1, turns + 1)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice([f"say {k} {'more ' * k}" for k in range(choice)] + [None, ""])))
    rows += rng.sample(rows, n // 5) + [(None, 1, "user", "nobody's"), (None, None, None, None)] * 50
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, rows, size", [(1, 3, 100), (2, 50, 1 << 20), (3, 1, 400)])
def test_trie_against_all_prefixes(spark, monkeypatch, seed, rows, size):
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", rows)
    monkeypatch.setattr(prefix_trie, "RANGE", size)
    data = conversations(random.Random(seed), 150)
    df = spark.createDataFrame(data, TURNS).repartition(4)
    own = prefix_trie.turns_of(df)
    plain = {r["conv_id"]: tuple(bytes(t["digest"]) for t in r["turns"]) for r in own.collect()}
    assert len(plain) == 150
    assert found_trie(prefix_trie.trie(prefix_trie.paths_of(prefix_trie.rebuilt(own)))) == plain_trie(plainly_rebuilt(data))


def test_trie_of_hot_paths(spark, monkeypatch):
    """Copies of one conversation, and one long one, over many ranges."""
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", 7)
    monkeypatch.setattr(prefix_trie, "RANGE", 600)
    data = [(c, t, "user", f"same {t}") for c in range(200, 320) for t in range(3)] + [(c, 0, "user", "same 0") for c in range(60)]
    data += [(1000, t, "user", f"turn {t % 7}") for t in range(400)] + [(1001, t, "user", f"turn {t % 7}") for t in range(390)]
    df = spark.createDataFrame(data, TURNS).withColumn("path", F.lit("clash")).withColumn("words", F.lit(0))
    plain = collections.defaultdict(tuple)
    for c, _, role, text in data:
        plain[c] += ((role, text),)
    assert found_trie(prefix_trie.trie(prefix_trie.paths_of(prefix_trie.turns_of(df)))) == plain_trie(plain)


def test_trie_of_few_conversations(spark):
    own = lambda rows: found_trie(prefix_trie.trie(prefix_trie.paths_of(prefix_trie.rebuilt(prefix_trie.turns_of(spark.createDataFrame(rows, TURNS))))))
    assert own([]) == [] and own([(None, 1, "user", "x")]) == []
    rows = [(5, 0, "user", "x")]  # the first turn goes where its base isn't there
    assert own(rows) == plain_trie(plainly_rebuilt(rows))
    assert own([(c, None, None, None) for c in range(30)]) == plain_trie(plainly_rebuilt([(c, None, None, None) for c in range(30)]))


def test_loser_tree_keeps_shared_turns():
    rng = random.Random(8)
    for k in (0, 1, 2, 5, 9):
        rows = [(b"".join(bytes([rng.randrange(2)]) * 16 for _ in range(rng.randrange(6))), i, b"") for i in range(40)]
        runs = [sorted(r for r in rows if r[1] % k == j) for j in range(k)] if k else []
        led = [[(*r, prefix_trie.shared_turns(a[0], r[0]) if a else 0) for a, r in zip([None, *run], run)] for run in runs]
        out = list(prefix_trie.LoserTree([iter(r) for r in led]))
        assert [r[:3] for r in out] == (sorted(rows) if k else [])
        assert all(b[3] == prefix_trie.shared_turns(a[0], b[0]) for a, b in itertools.pairwise(out))


# 13 quality classifier


def test_products_are_all_pairs():
    rng = np.random.default_rng(1)
    size = 12
    weights, factors = rng.normal(size=size), rng.normal(size=(size, 3))
    rows = [(np.sort(rng.choice(size, n, replace=False)), rng.normal(size=n)) for n in (1, 4, 12)]
    begins, at, values = np.cumsum([0, 1, 4]), np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    got = quality_classifier.products(begins, at, values, weights, factors)[0]
    for g, (a, v) in zip(got, rows):
        pairs = sum(factors[a[i]] @ factors[a[j]] * v[i] * v[j] for i, j in itertools.combinations(range(len(a)), 2))
        assert g == pytest.approx(weights[a] @ v + pairs)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_classifier_on_held_out_labels(spark, tables):
    docs, labels = tables
    rows = queries.op13_quality_classifier(spark, SF).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert queries.op13_quality_classifier(spark, SF).count() == docs.count()


def test_classifier_learns_from_what_it_may(spark, tables):
    docs, labels = tables
    some = docs.where("doc_id < 300").select("doc_id", "text", "n_chars", "lang", "source")
    own = labels.where("doc_id < 300")
    plain = quality_classifier.learned(some, own)
    other = own.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", 1 - F.col("toxic"))
    again = quality_classifier.learned(some.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")).repartition(7), other.unionByName(other))
    assert np.array_equal(plain.weights, again.weights) and np.array_equal(plain.factors, again.factors) and plain.bias == again.bias
    held = {r[0] for r in own.select("doc_id").collect() if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    vectors, values = quality_classifier.sample(some, own, 1000)
    assert len(values) == own.count() - len(held)
    assert len(quality_classifier.sample(some, own, 20)[1]) == 20


def test_classifier_of_odd_rows(spark, tables):
    docs, labels = tables
    machine = quality_classifier.learned(docs.where("doc_id < 200"), labels.where("doc_id < 200"))
    odd = frame(spark, edge_texts(), [(None, "tie tie tie", None, None, None), (3, "word", "en", "s", None), (3, "word", "en", "s", 4)]).withColumn("score", F.lit("clash"))
    rows = quality_classifier.scored(odd.repartition(3), machine).collect()
    assert len(rows) == len(edge_texts()) + 3 and all(0 <= r["score"] <= 1 for r in rows)
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(round(r["score"], 9))
    assert by[8] == by[9] and len(by[3]) == 2 and len(by[0]) == 1
    none = labels.where("false")
    half = quality_classifier.learned(docs, none)
    assert {r["score"] for r in quality_classifier.scored(odd, half).collect()} == {0.5}
    conflict = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (7, 1)], "doc_id long, quality int")
    assert [float(x) for x in quality_classifier.sample(odd, conflict)[1]] == [x for i, x in ((1, 0.5), (7, 1.0)) if zlib.crc32(str(i).encode()) % 5]
    assert quality_classifier.scored(empty(spark), machine).count() == 0
    assert quality_classifier.scored(odd.drop("n_chars"), machine).count() == len(rows)
