"""Training corpus from `documents`: quality rules, near-duplicates, benchmark leaks, personal data, mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import delete, disposed, forget, settled, shared_dir, table
from postsieve.llm.lines import judge_documents, without_lines
from postsieve.llm.mixing import plan_mix, training_order
from postsieve.llm.near import near_duplicates
from postsieve.llm.phrases import decontaminate
from postsieve.llm.pii import sanitise


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with a digest of the whole row in _key."""
    return docs.withColumn("_key", F.md5(F.to_json(F.struct(*docs.columns))))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the rules or are depleted, and without lines that repeat across a host."""
    rows = _keyed(docs)
    # verdicts are stored, texts are not: what a stage stores may lie there until the last one ends
    verdicts = lambda: judge_documents(rows.select("_key", "text", "source"), hashes=True).where("kept").select("_key", "taken_lines")
    judged = settled(spark, "judged", lambda: verdicts().dropDuplicates(["_key"]))
    rows = rows.join(judged.hint("merge"), "_key")
    return _measured(rows.withColumn("text", without_lines(F.col("text"), F.col("taken_lines"))).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest id."""
    own = F.md5(F.to_json(F.struct("doc_id", F.md5("text").alias("text"))))
    hashed = docs.select("doc_id", "text", own.alias("_own"))
    first = settled(spark, "first", lambda: near_duplicates(hashed).where("is_first").select("_own").distinct())
    # texts are dealt once, by the key that both the join and the choice of one row go by
    rows = docs.withColumn("_own", own).join(first.hint("merge"), "_own", "left_semi")
    return rows.dropDuplicates(["_own"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark."""
    rows = _keyed(docs)
    items = table(spark, sf_dir, "benchmark")
    leaks = lambda: decontaminate(rows.select("_key", "text"), items).where("contaminated").select("_key").distinct()
    found = settled(spark, "leaks", leaks)
    return rows.join(found, "_key", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, disclosing terms generalised or removed."""
    return _measured(sanitise(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and pass in training order, with size, source_size, target, taken, pass and position."""
    rows = _keyed(docs)
    return training_order(rows, plan_mix(rows.select("_key", "text", "source")), "_key").drop("_key")


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("pii", personal_data),
    ("source mix", source_mix),
]

#: The stages hash, align and sample; tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again.

    What a stage stored on its way goes when its result is written, and so does the result before it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        with disposed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        forget(spark)  # a stage's shuffle files go when the driver forgets its plans
        docs, before = spark.read.parquet(path), path
    return docs
