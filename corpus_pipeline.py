"""The training-data pipeline: each stage takes what its predecessor kept and returns the columns of documents, the last one
the packed pieces. run() writes each stage's result to the shared folder and reads it for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytospark.llm import bloom, language, near_dedup, packing, secrets, substring_dedup
from cytospark.llm.common import renamed, settled, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found. Those without text or without a letter go, and only those: where no language can be
    learned, as no text that may be learned from has a label, all others stay. No document needs a label, and none is changed."""
    own, name = renamed(docs)
    names, logs = language.learned(docs)
    found = language.identify(own, *((names, logs) if names else language.unlearned()), text=name["text"])
    return found.where("lang_pred <> 'und'").select(own.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. A document is an id with a text, so that
    different texts under one id are judged each; of rows that repeat id and text one stays. Rows with a null id stay. A near
    duplicate shares 80 % of the distinct runs of five words."""
    own, name = renamed(docs)
    marked, ids = numbered(own, name["doc_id"], name["text"])
    found = settled(near_dedup.near_duplicates(marked, words=5, similarity=0.8, doc_id="_node", text=name["text"]).where("doc_id is not null"))
    groups = found.where("not kept").select("component_id").distinct()
    members = found.join(groups, "component_id").select(F.col("doc_id").alias("_node"), "component_id").distinct()
    members = settled(members.join(ids, "_node"))
    first = members.groupBy("component_id").agg(F.min(F.struct("_id", "_node"))["_node"].alias("_first"))
    gone = settled(members.join(first, "component_id").where("_node <> _first").select("_node"))
    again = ids.where("n > 1").select("_node")
    # only the texts of these are moved
    some, others = bloom.parted(marked, "_node", gone.union(again).distinct())
    left = some.join(gone, "_node", "left_anti").dropDuplicates(["_node"])
    return others.unionByName(left).select(own.columns).toDF(*docs.columns)


def numbered(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """docs with _node, a number of its own for each pair of id and text (null for a null id); and for each of them _node, _id and n,
    its rows. A pair's number is a hash of 63 bits, unless two pairs, as told by the texts' SHA-256, share one: these are ranked
    and get negative numbers. Of 10^10 pairs some ten share a hash."""
    own, digest = F.col(doc_id).cast("long"), F.sha2(F.col(text), 256)
    marked = docs.withColumn("_hash", F.when(own.isNotNull(), hashed(own, F.col(text))))
    rows = marked.where("_hash is not null").select("_hash", F.struct(own.alias("id"), digest.alias("digest")).alias("pair"))
    pairs = settled(rows.groupBy("_hash", "pair").agg(F.count(F.lit(1)).alias("n")))
    several = pairs.groupBy("_hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("_hash")
    ranked = settled(pairs.join(several, "_hash").select("_hash", "pair", (-F.row_number().over(Window.orderBy("_hash", "pair"))).cast("long").alias("_rank")))
    ids = pairs.join(ranked, ["_hash", "pair"], "left").select(F.coalesce("_rank", "_hash").alias("_node"), F.col("pair.id").alias("_id"), "n")
    if ranked.isEmpty():
        return marked.withColumnRenamed("_hash", "_node"), ids
    # only rows of these hashes are moved
    there, others = bloom.parted(marked, "_hash", several)
    right = ranked.select(F.col("_hash").alias("_there"), F.col("pair").alias("_pair"), "_rank")
    met = there.join(right, (F.col("_hash") == F.col("_there")) & F.col("_pair.id").eqNullSafe(own) & F.col("_pair.digest").eqNullSafe(digest), "left")
    met = met.withColumn("_node", F.coalesce("_rank", "_hash")).drop("_there", "_pair", "_rank", "_hash")
    return met.unionByName(others.withColumnRenamed("_hash", "_node")), ids


def hashed(doc_id: Column, text: Column) -> Column:
    """A number of 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 1)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier one has; those of which nothing is left go."""
    return substring_dedup.remove_repeats(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_duplicate_stage),
    ("substring_dedup", repeated_passage_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Language models, tokenizers and sketches can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
