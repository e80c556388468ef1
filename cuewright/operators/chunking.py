"""Cuts an ordered stream into chunks of about equal characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_numbers(blocks: DataFrame, key: str, pos: str, size: str, limit: int) -> DataFrame:
    """(key, pos, chunk) of rows (key, pos, size).

    There are max(1, ceil(total / limit)) chunks. With no fewer chunks than rows each row is one. Else a
    chunk closes once its running size reaches total / n, the count starts anew, and the last takes the rest.
    The fold runs over the sizes alone, one array a key.
    """
    if limit <= 0:
        raise ValueError("the limit must be positive")
    runs = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(size).cast("bigint").alias("z")))).alias("rows"), F.sum(size).alias("total"))
    n = F.greatest(F.lit(1).cast("bigint"), F.floor((F.col("total") + (limit - 1)) / limit))
    state = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("seen"), F.array(F.lit(0)).alias("begins"))

    def step(s, row):
        held, seen = s["held"] + row["z"], s["seen"] + 1
        # size(begins) - 1 chunks have closed; only a cut, never a row, makes the state longer
        close = (held * n >= F.col("total")) & (F.size(s["begins"]) < n)
        return F.struct(
            F.when(close, F.lit(0).cast("bigint")).otherwise(held).alias("held"), seen.alias("seen"), F.when(close, F.array_append(s["begins"], seen)).otherwise(s["begins"]).alias("begins")
        )

    begins = F.aggregate("rows", state, step, lambda s: s["begins"])
    begins = F.when(n >= F.size("rows"), F.sequence(F.lit(0), F.size("rows") - 1)).otherwise(begins)
    ends = F.concat(F.slice("begins", 2, F.size("begins")), F.array(F.size("rows")))
    parts = runs.select(key, "rows", begins.alias("begins")).select(key, "rows", F.posexplode(F.arrays_zip(F.col("begins").alias("a"), ends.alias("b"))).alias("chunk", "part"))
    cut = F.slice("rows", F.col("part.a") + 1, F.col("part.b") - F.col("part.a"))
    return parts.select(key, F.col("chunk").cast("bigint").alias("chunk"), F.explode(cut).alias("r")).select(key, F.col("r.p").alias(pos), "chunk")


def bounds(chunked: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """First and last index, and start of the first and end of the last block, of each chunk."""
    return chunked.groupBy(*keys).agg(
        F.min_by("index", pos).alias("from_index"), F.max_by("index", pos).alias("to_index"), F.min_by("start_ms", pos).alias("start_ms"), F.max_by("end_ms", pos).alias("end_ms")
    )
