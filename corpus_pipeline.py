"""Corpus pipeline: quality rules, near-duplicate removal, repeated passages, benchmark passages, packing.

Each stage keeps all columns, whatever their names, and gives an empty table for an empty one. Null texts fail the quality
rules, so they go in the first stage; later ones keep them. Very long texts are judged whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, jaccard_join, packing, quality_rules, suffix_dedup
from vellum.llm.common import filtered, id_filter, keep, scratch, where_computed
from vellum.llm.entry import learned_rules, word_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    judged = quality_rules.judge(packed, learned_rules(spark, sf_dir))
    return where_computed(judged, F.col("kept")).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def first_hash(text: str) -> F.Column:
    return F.xxhash64(text)


def keyed(docs: DataFrame) -> DataFrame:
    """docs as key, row (a struct of all columns). The key is a hash of the text, or, for texts that share theirs with another text,
    an independent second one: a hash of 64 bits alone would take some hundred of 10^11 texts for others."""
    one, two = first_hash("text"), F.xxhash64(F.lit("second"), "text")
    shared = docs.groupBy(one.alias("key")).agg(F.min(two).alias("least"), F.max(two).alias("most")).where("least <> most").select("key", F.lit(True).alias("shared"))
    with scratch(docs.sparkSession):
        shared = keep(shared, "shared")
    packed = docs.select(one.alias("key"), two.alias("other"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if shared.isEmpty():
        return packed.select("key", "row")
    return packed.join(shared, "key", "left").select(F.when(F.col("shared"), F.col("other")).otherwise(F.col("key")).alias("key"), "row")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a similarity of 0.8 or more: the one with the smallest
    doc_id (nulls last), of several texts with that doc_id the one with the smallest hash, of equal rows any one. Documents
    are told apart by their texts, so null and repeated doc_ids don't matter; texts without words stay."""
    packed = keyed(docs)
    with scratch(spark):
        linked = jaccard_join.link(packed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), k=5, percent=80).where("n_shingles > 0")
        several = linked.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
        several = linked.join(several, "component_id", "left_semi").select(F.col("doc_id").alias("key"), "component_id").distinct()
        several = keep(several, "several")
    # Only rows that may have near copies are shuffled.
    held = spark.sparkContext.broadcast(id_filter(several.select("key")))
    alone, other = (filtered(packed, "key", held, inside) for inside in (False, True))
    other = other.join(several, "key", "left")
    rank = F.struct(F.col("row.doc_id").isNull().alias("none"), F.coalesce("row.doc_id", F.lit(0)).alias("id"), "key")
    best = other.where("component_id is not null").groupBy("component_id").agg(F.min(rank).alias("best"))
    chosen = other.join(best, "component_id").where(rank == F.col("best")).groupBy("component_id").agg(F.first("row").alias("row"))
    kept = alone.select("row").union(other.where("component_id is null").select("row")).union(chosen.select("row"))
    return kept.select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words, and the 400-byte strings, that occur more than once."""
    return suffix_dedup.passages(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an approximate copy of a benchmark passage, by their texts: null and repeated doc_ids don't matter."""
    packed = keyed(docs)
    found = decontaminate.occurrences(packed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    with scratch(spark):
        hit = keep(found.select(F.col("doc_id").alias("key")).distinct(), "leaks")
    return packed.join(hit, "key", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.pack(docs, word_vocabulary(), end_id=1, capacity=2048)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("benchmark decontamination", benchmark_passages), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            with scratch(spark):
                docs = keep(docs, f"stage_{i}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
