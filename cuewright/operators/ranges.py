"""Interval arithmetic: lattices of timestamps, gaps and split points, cyclic choice, stages, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lattice(start: Column, end: Column, step: int, with_start: bool, with_end: bool) -> Column:
    """Sorted distinct multiples of step in [start, end), in ms, with the ends if asked for."""
    if step <= 0:
        raise ValueError("the step must be positive")
    first = F.ceil(start / step) * step
    none = F.array().cast("array<bigint>")
    inner = F.when(first < end, F.sequence(first, end - 1, F.lit(step).cast("bigint"))).otherwise(none)
    extra = F.array_compact(F.array(start if with_start else F.lit(None).cast("bigint"), end if with_end else F.lit(None).cast("bigint")))
    return F.array_sort(F.array_distinct(F.concat(inner, extra)))


def even_points(duration: Column, n: int) -> Column:
    """n points that cut a duration evenly; none for an empty one."""
    points = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: duration / (n + 1) * i) if n > 0 else F.array().cast("array<double>")
    return F.when(duration > 0, points).otherwise(F.array().cast("array<double>"))


def split_points(ranges: DataFrame, key: str, duration: str) -> DataFrame:
    """(key, at): the middle of the gap whose middle is nearest to half the duration; without gaps the nearest boundary.

    ranges: (key, start_ms, end_ms, pos, duration), rows of a key with one duration. Ties: the earlier.
    """
    order = Window.partitionBy(key).orderBy("start_ms", "pos")
    before = F.coalesce(F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = ranges.select(key, duration, F.greatest(before, F.lit(0)).alias("a"), F.col("start_ms").alias("b"))
    tail = ranges.groupBy(key).agg(F.max(duration).alias(duration), F.greatest(F.max("end_ms"), F.lit(0)).alias("a"), F.max(duration).alias("b"))
    gaps = gaps.unionByName(tail).where("b > a")
    far = F.abs(F.col("a") + F.col("b") - F.col(duration))  # twice the distance of the middles
    best = gaps.groupBy(key).agg(F.min(F.struct(far.alias("far"), (F.col("a") + F.col("b")).alias("twice"))).alias("g"))
    ends = ranges.select(key, duration, F.explode(F.array("start_ms", "end_ms")).alias("b")).where((F.col("b") > 0) & (F.col("b") < F.col(duration)))
    edge = ends.groupBy(key).agg(F.min(F.struct(F.abs(2 * F.col("b") - F.col(duration)).alias("far"), F.col("b"))).alias("e"))
    keys = ranges.select(key).distinct()
    return keys.join(best, key, "left").join(edge, key, "left").select(key, F.coalesce(F.col("g.twice") / 2, F.col("e.b").cast("double")).alias("at"))


def cyclic(items: DataFrame, ordinal: str, n: int, following: int, k: int) -> DataFrame:
    """k items from the ordinal ``following`` on, wrapping round n; with turn, their place in the choice."""
    if k > n:
        raise ValueError("fewer items than asked for")
    turn = F.pmod(F.col(ordinal) - following, F.lit(n))
    return items.withColumn("turn", turn).where(F.col("turn") < k)


def next_stages(stages: DataFrame, done: DataFrame, key: str, keys: DataFrame | None = None, skipped: DataFrame | None = None, stop_after: str | None = None) -> DataFrame:
    """(key, stage_ord, stage): each key's first stage that isn't done; stages: (stage_ord, stage), done: (key, stage).

    keys: all keys, else those with a stage done. skipped: (key, stage) of optional stages that a key goes without.
    With stop_after nothing is due behind that stage, whether it is done or not.
    """
    last = stages.where(F.col("stage") == stop_after).select(F.col("stage_ord").alias("last")) if stop_after else None
    due = stages if last is None else stages.join(F.broadcast(last), F.col("stage_ord") <= F.col("last")).drop("last")
    settled = done.select(key, "stage") if skipped is None else done.select(key, "stage").unionByName(skipped.select(key, "stage"))
    wanted = (done if keys is None else keys).select(key).distinct().join(F.broadcast(due))  # eleven stages
    open_ = wanted.join(settled.distinct(), [key, "stage"], "left_anti")
    return open_.groupBy(key).agg(F.min(F.struct("stage_ord", "stage")).alias("m")).select(key, "m.stage_ord", "m.stage")


def content_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def missing_work(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return wanted.join(cached.select(key).distinct(), key, "left_anti")
