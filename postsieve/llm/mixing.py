"""Mix of sources by time-varying weights: shares, cumulative demand, training positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.llm.common import held, packed, stored, unpacked, words_of

WEIGHTS = (3.0, 1.0, 2.0)
#: Weight of a source over training time as (time, weight) knots, straight in between: early, even and late sources in turn.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
BUCKETS = 2048


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Target per source from (source, source_size): weight, cap and target.

    Sources in code-point order, NULL last, have `weights` in turn and share `share` times all sizes. A target above
    `most` times its source's size stops there and the excess goes to the others by weight, until none is above. That
    has one solution, least(cap, level * weight), whose level follows from the caps in the order of cap / weight. One row per
    source: the two windows below sort sources, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    rows = rows.withColumns({"turn": turn, "cap": most * F.col("source_size").cast("double")})
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    full_before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_after = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    demand = share * F.sum("source_size").over(everyone)
    rows = rows.withColumn("level", (demand - full_before) / weight_after)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    rows = rows.withColumn("fill", F.first(fits, ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fill") * F.col("weight")))
    return rows.select("source", "source_size", "weight", "turn", "cap", target.alias("target"))


def _schedule_columns(turn: Column, schedules: tuple) -> Column:
    """Per source: segments of its schedule with the integral up to their start, as a share of the whole."""
    out = []
    for knots in schedules:
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        total, before, parts = sum(areas), 0.0, []
        for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
            values = {"start": t0, "length": t1 - t0, "w0": w0, "w1": w1, "before": before / total, "total": total}
            parts.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()]))
            before += area
        out.append(F.array(*parts))
    return F.element_at(F.array(*out), F.pmod(turn, F.lit(len(out))) + 1)


def time_of(demand: Column, segments: Column) -> Column:
    """Training time in [0, 1] at which the share `demand` of a source has been asked for: the inverse of the integral."""
    last = F.element_at(F.filter(segments, lambda s: s["before"] <= demand), -1)
    y = (demand - last["before"]) * last["total"] / last["length"]
    root = F.sqrt(F.greatest(last["w0"] * last["w0"] + 2 * (last["w1"] - last["w0"]) * y, F.lit(0.0)))
    x = F.when(y <= 0, F.lit(0.0)).otherwise(2 * y / (last["w0"] + root))
    return F.least(last["start"] + x * last["length"], F.lit(1.0))


def plan_mix(
    docs: DataFrame, text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS, schedules: tuple = SCHEDULES, buckets: int = BUCKETS, seed: int = 42,
) -> DataFrame:
    """`docs` without the text, with size, source_size, target, taken and positions (training time of each pass, ascending).

    A source's documents are lined up in an order drawn by hash, once per pass; pass p covers the words from
    (p-1) * source_size on. The source's demand grows with its weight schedule, and where it reaches a document's first
    word, that is the document's position. Demand ends at the target: the document at that point is taken in part, later ones
    not (positions empty, taken 0). NULL texts have size 0 and are not taken; a NULL source is a source. Repeated rows are
    documents of their own. Sums over the order go through `buckets` ranges of the hash per source, so a source with a third of
    all rows is many tasks' work. No rows give no rows. Columns of `docs` called like the new ones are replaced.
    """
    new = ("size", "source_size", "target", "taken", "positions")
    rows = packed(docs, (*new, text), text=F.col(f"`{text}`"), source=F.col(f"`{source}`"))
    rows = held(rows, size=word_count(F.col("text"))).drop("text")
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), F.to_json("row"), "size"))
    # ranges of the hash: its upper bits
    rows = rows.withColumn("bucket", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * buckets).cast("int"))
    sums = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "bucket-sizes")
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, most, weights)
    targets = targets.withColumn("segments", _schedule_columns(F.col("turn"), schedules)).drop("turn", "weight", "cap")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    inside = Window.partitionBy("source", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = _null_safe(rows, stored(_null_safe(starts, targets), "bucket-starts"), "bucket")
    offset = F.col("start") + F.col("inside")
    end = F.round("target").cast("long")
    part = lambda p: F.greatest(F.lit(0), F.least(F.col("size"), end - (offset + p * F.col("source_size"))))
    passes = range(math.ceil(most))
    taken = sum((part(p) for p in passes), F.lit(0)).cast("long")
    asked = lambda p: (offset + p * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0))
    at = [F.when(part(p) > 0, time_of(asked(p), F.col("segments"))) for p in passes]
    return unpacked(joined.withColumns({"taken": taken, "positions": F.array_compact(F.array(*at))}), *new)


def _null_safe(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on source, where NULL meets NULL, and on `keys`."""
    right = right.withColumnsRenamed({n: f"right_{n}" for n in ("source", *keys)})
    same = F.col("source").eqNullSafe(F.col("right_source"))
    for n in keys:
        same &= F.col(n) == F.col(f"right_{n}")
    return left.join(right, same).drop("right_source", *[f"right_{n}" for n in keys])


def training_order(docs: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Texts of `docs` in training order by a range sort: a row per document and pass of `plan`, with position and pass.

    taken is then the words of that pass. `key` (not NULL) tells the rows of `docs`; each meets the plan rows with its key.
    """
    names = ("size", "source_size", "target", "taken", "pass", "position")
    rows = plan.select(key, *names[:4], F.posexplode("positions").alias("pass", "position"))
    rows = rows.withColumn("taken", F.least(F.col("taken") - F.col("size") * F.col("pass"), F.col("size")))
    return docs.drop(*names).join(rows, key).orderBy("position", key, "pass")
