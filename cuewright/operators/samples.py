"""Sampling times of chunks: windows that skip an intro, lattice points in them, names and manifests of what is cut out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import lattice

#: Frames closer to the end than this can't be decoded.
TRAILING_MS = 1500


def duration(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0).cast("bigint"))


def chunk_window(start: Column, end: Column, chunk: Column, intro_ms: int) -> tuple[Column, Column]:
    """A chunk's sampling window in ms: the first chunk's begins behind the intro, but never behind its end."""
    late = F.least(F.greatest(start, F.lit(intro_ms).cast("bigint")), end)
    return F.when(chunk == 0, late).otherwise(start), end


def whole_window(length: Column, intro_ms: int, trailing_ms: int = TRAILING_MS) -> tuple[Column, Column]:
    """The window of a whole video: behind the intro, clear of the end."""
    end = F.greatest(length - trailing_ms, F.lit(0).cast("bigint"))
    return F.least(F.lit(max(0, intro_ms)).cast("bigint"), end), end


def chunk_samples(chunks: DataFrame, keys: list[str], step_ms: int, intro_ms: int) -> DataFrame:
    """(keys, chunk, at_ms): the sampling times of (keys, chunk, start_ms, end_ms), both ends included."""
    start, end = chunk_window(F.col("start_ms"), F.col("end_ms"), F.col("chunk"), intro_ms)
    return chunks.select(*keys, "chunk", F.explode(lattice(start, end, step_ms, True, True)).alias("at_ms"))


def slug(first: Column, last: Column) -> Column:
    return F.format_string("%04d-%04d", first.cast("bigint"), last.cast("bigint"))


def seconds(ms: Column) -> Column:
    """1234 as 1.234."""
    return F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)


def segment_name(video: Column, first: Column, last: Column, start: Column, end: Column, step_s: int, side: int) -> Column:
    """The cache file of a chunk's sound: its range, and ten digits of a digest of all that shapes it."""
    told = F.concat_ws(":", video, slug(first, last), seconds(start), seconds(end), F.lit(str(step_s)), F.lit(str(side)))
    return F.concat(F.lit("chunk_"), slug(first, last), F.lit("_"), F.left(F.sha2(told, 256), F.lit(10)), F.lit(".opus"))


def manifest(chunk: Column, total: Column, first: Column, last: Column, start: Column, end: Column, audio: Column, frames: Column) -> Column:
    """A chunk's manifest as JSON."""
    span = F.struct(start.alias("start_ms"), end.alias("end_ms"))
    return F.to_json(F.struct(chunk.alias("chunk_index"), total.alias("total_chunks"), first.alias("from_index"), last.alias("to_index"), span.alias("time_range"), audio.alias("audio"), frames.alias("frames_ms")))


def progress_steps(lines: DataFrame, key: str, pos: str, line: str, length_ms: str) -> DataFrame:
    """(key, pos, step_ms): how far each progress line (out_time_us=n, clamped to the length) goes beyond the one before it, 0 at least."""
    from pyspark.sql import Window

    number = F.regexp_extract(line, r"^\s*out_time_[mu]s=\s*(-?\d+)\s*$", 1)
    told = lines.where(number != "").select(key, pos, F.least(F.floor(number.cast("bigint") / 1000), F.col(length_ms)).alias("now"))
    before = F.coalesce(F.lag("now").over(Window.partitionBy(key).orderBy(pos)), F.lit(0))
    return told.select(key, pos, F.greatest(F.col("now") - before, F.lit(0)).cast("bigint").alias("step_ms"))
