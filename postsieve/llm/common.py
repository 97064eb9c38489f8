"""Helpers of the training-data operators: table access, shared intermediate tables, skew-safe joins."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`; only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for paths in _collecting:
        paths.append(path)
    return path


_collecting: list[list[str]] = []


@contextmanager
def disposed(spark: SparkSession) -> Iterator[None]:
    """Deletes the shared folders made inside, once a result that needs them is written elsewhere."""
    paths: list[str] = []
    _collecting.append(paths)
    try:
        yield
    finally:
        _collecting.pop()
    for path in paths:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def stored(rows: DataFrame, label: str, *folders: str) -> DataFrame:
    """`rows` written to the shared folder (in subfolders by the columns `folders`) and read again: no lineage, no second evaluation."""
    path = shared_dir(rows.sparkSession, label)
    (rows.write.partitionBy(*folders) if folders else rows.write).parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.stored_at = path
    return out


def discard(rows: DataFrame) -> None:
    """Delete a table of `stored` that nothing reads any more."""
    delete(rows.sparkSession, rows.stored_at)


def forget(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing holds any more: they go when the driver forgets their plans.

    Python's handles of plans are in reference cycles, so they hold the plans until Python's collector has run.
    """
    gc.collect()
    spark._jvm.System.gc()


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of `make()`, written and read again; what was stored and shuffled on the way is deleted."""
    path = shared_dir(spark, label)
    with disposed(spark):
        rows = make()
        rows.write.parquet(path)
    schema = rows.schema
    del rows
    forget(spark)
    return spark.read.schema(schema).parquet(path)


def salted_join(rows: DataFrame, per_key: DataFrame, keys: list[str], spread: Column, how: str, salts: int = 16) -> DataFrame:
    """Join of `rows` to at most one row per key; a hot key is spread over `salts` partitions by `spread`.

    Each row of `per_key` is copied once per salt, so that no key, however frequent in `rows`, meets in one task.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return left.join(per_key.withColumn("_salt", copies), [*keys, "_salt"], how).drop("_salt")


def words_of(text: Column) -> Column:
    """Array of the maximal runs of other characters than U+0020 and U+0009 to U+000D; empty for NULL."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) > 0, F.split(inner, SPACE)).otherwise(F.array().cast("array<string>"))


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with columns that are evaluated once; filters on other columns still pass below them."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    names = list(rows.columns)
    out = rows.select("*", F.explode(F.array(packed)).alias("_held"))
    return out.select(*names, *[F.col("_held")[n].alias(n) for n in columns])


def own_column(rows: DataFrame, wish: str) -> str:
    """A column name that `rows` does not have yet."""
    taken = {c.lower() for c in rows.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def row_spread(rows: DataFrame) -> Column:
    """Hash of a row's plain columns: spreads equal keys, and is the same when a lost task runs again."""
    plain = [F.col(f"`{n}`") for n, kind in rows.dtypes if not any(k in kind for k in ("map<", "variant", "void"))]
    return F.xxhash64(*plain) if plain else F.lit(0)


def packed(docs: DataFrame, without: tuple[str, ...], **columns: Column) -> DataFrame:
    """The columns of `docs` in one struct `row` (but for `without`), beside named ones: no name of theirs meets one used inside."""
    carried = [F.col(f"`{c}`") for c in docs.columns if c not in without]
    return docs.select(F.struct(F.lit(0).alias("_"), *carried).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(rows: DataFrame, *new: str) -> DataFrame:
    """The columns that `packed` put away, followed by new ones."""
    names = [n for n in rows.schema["row"].dataType.names if n != "_"]
    return rows.select(*[F.col("row").getField(n).alias(n) for n in names], *new)


def row_key(text: Column) -> Column:
    """Digest of a packed row and its text: rows that repeat share it, and get equal results by it."""
    return F.md5(F.concat(F.to_json("row"), F.lit("|"), F.coalesce(text, F.lit("\x00"))))
