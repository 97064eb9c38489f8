"""Key index of the jobs table: what a batch must know of stored jobs, without reading them.

A row per key of a stored job (its hash, and its external id unless blank), in folders by hash prefix below the folder of
the batch that wrote it. Keys are kept as 16-byte digests, and a job's hash beside its id only: next to its own digest it
would say nothing new. A batch asks it once. `origin` names the batch that stored the job, also after folders were merged,
so that a batch that runs again still leaves its own keys out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key binary, job_hash string, origin string, batch_id string, part int"
PARTS = 16
FOLDER = "job_key_digests"


def _part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _own() -> Column:
    """Digest of a row's hash, never NULL: a filter for that would keep two joins from reading one shuffle."""
    return F.coalesce(_digest(F.col("canonical_hash")), F.lit(b""))


def _keys(rows: DataFrame, *carried: Column) -> DataFrame:
    """A row per key of `rows` (canonical_hash, external_id): the carried columns, rank (hash before id), key, job_hash and part."""
    hash_ = F.col("canonical_hash")
    by_hash = F.struct(F.lit(0).alias("rank"), _digest(F.concat(F.lit("hash:"), hash_)).alias("key"), F.lit(None).cast("string").alias("job_hash"))
    named = F.concat(F.lit("id:"), F.nullif("external_id", F.lit("")))
    by_id = F.struct(F.lit(1).alias("rank"), _digest(named).alias("key"), hash_.alias("job_hash"))
    each = rows.select(*carried, F.explode(F.array(by_hash, by_id)).alias("k")).where("k.key is not null")
    return each.select("*", "k.*").drop("k").withColumn("part", _part(F.col("key")))


def _folders(spark: SparkSession, root: str, pattern: str) -> list:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{FOLDER}/{pattern}")
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [(files, s.getPath()) for s in files.globStatus(place) or []]


def _write(keys: DataFrame, root: str, batch_id: str) -> None:
    # a folder's rows meet in few files, sorted, a hot prefix split by size
    _write_dealt(keys.select("key", "job_hash", "origin", "part").hint("rebalance", "part"), root, batch_id)


def _write_dealt(keys: DataFrame, root: str, batch_id: str) -> None:
    rows = keys.sortWithinPartitions("part", "key")
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{root}/{FOLDER}/batch_id={batch_id}")


def create_index(spark: SparkSession, root: str, jobs: DataFrame) -> None:
    """Index the stored `jobs` (with batch_id), unless an index is there."""
    if not _folders(spark, root, "batch_id=*/_SUCCESS"):
        _write(_keys(jobs, F.col("batch_id").alias("origin")), root, "first")


def read_index(spark: SparkSession, root: str, without_batch: str | None = None) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(f"{root}/{FOLDER}")
    return rows if without_batch is None else rows.where(F.col("origin") != without_batch)


def write_keys(stored: DataFrame, root: str, batch_id: str) -> None:
    """Replace the keys of one batch by those of the jobs it stored."""
    _write(_keys(stored, F.lit(batch_id).alias("origin")), root, batch_id)


def compact_index(spark: SparkSession, root: str) -> None:
    """Merge the folders of all batches into one; not while a batch runs.

    The merged folder is complete before the others go. Dying in between leaves keys twice, which changes no answer.
    """
    old = _folders(spark, root, "batch_id=*")
    # dealt by ranges, which both brings repeats together and puts a folder's rows in few files
    dealt = read_index(spark, root).select("key", "job_hash", "origin", "part").repartitionByRange("part", "key")
    _write_dealt(dealt.distinct(), root, f"merged-{uuid.uuid4().hex}")
    for files, path in old:
        files.delete(path, True)


def split_by_index(new: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `new` (one per canonical_hash) that no stored job is, and those that one is, under its hash.

    A row is known by its hash, or else by its external id; blank ids tell nothing. The index is read once, as two
    slim columns: streamed past the keys of the batch if Spark finds these small enough to broadcast.
    """
    asked = _keys(new, _own().alias("own")).select("own", "rank", "key", "part")
    found = asked.join(index.select("part", "key", "job_hash"), ["part", "key"])
    found = found.groupBy("own").agg(F.min(F.struct("rank", "job_hash")).alias("_found"))
    rows = new.withColumn("own", _own()).join(found, "own", "left")
    known = rows.where("_found is not null").withColumn("canonical_hash", F.coalesce("_found.job_hash", "canonical_hash"))
    return rows.where("_found is null").select(*new.columns), known.select(*new.columns)
