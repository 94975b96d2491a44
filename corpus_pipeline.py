"""Corpus pipeline over ``documents``: quality classifier, quality rules, near-duplicate join, surrogates
for personal data, packing.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before kept. All but the last return the
columns of ``documents``. Documents whose id is null or repeated are treated row by row, so a near-duplicate
group keeps exactly one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import base, jaccard, packing, pii, quality, queries, rules

#: SQL cannot express the stages; they are tested against brute-force versions.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among them."""
    model = quality.fit_quality(docs, base.table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model, threshold=0.3)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the base rules and are no less like the trusted target than like the corpus."""
    trusted = base.table(spark, sf_dir, "labels").where("quality = 1")
    return rules.keep_by_rules(docs, rules.fit_ratio(docs, trusted))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links by five-word shingles with a similarity of at least 0.8: that of the smallest id (null ids last).

    Rows are told apart by their place in ``docs``, a table, and not by their id. Texts without a word are no group.
    """
    row = base.free_name(docs.columns, "row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    groups = jaccard.near_duplicates(placed.select(key.alias("doc_id"), "text"), n=5, percent=80)
    gone = groups.where("component_id.row <> doc_id.row").select(F.col("doc_id.row").alias(row))
    return placed.join(base.bounded_broadcast(gone, jaccard.BROADCAST_ROWS), row, "left_anti").select(*docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the text."""
    changed = pii.replace_personal_data(docs, key=pii.session_key(spark)).drop("n_entities")
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 1024 tokens."""
    return packing.pack(docs, queries.byte_bpe_spec(), end_id=2, capacity=1024)


STAGES = [("quality_classifier", classify), ("quality_rules", judge), ("ngram_jaccard_join", deduplicate), ("pii_surrogates", pseudonymise), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's documents written to the shared folder for the next."""
    docs = base.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = base.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
