"""Repair of translated chunks that departed from their source: local strategies in order, then mappings asked for.

source: (chunk, pos, timecode); output: (chunk, pos, timecode, text); positions from 0 within a chunk. A chunk without
problems stays as it is. For the others the first strategy that gives an answer is taken and validated once; if it
fails, or none answers, only a mapping can help. Texts are never rewritten, only placed.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from . import align
from .payloads import mapping_error, mapping_rows

ROW = ["chunk", "pos", "timecode", "text"]


def only(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    return rows.join(chunks.select("chunk").distinct(), "chunk", "left_semi")


def without(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    return rows.join(chunks.select("chunk").distinct(), "chunk", "left_anti")


def valid(source: DataFrame, candidate: DataFrame, tolerance: int) -> DataFrame:
    """The candidate's rows of the chunks that have no problems left."""
    return only(candidate, align.problems(only(source, candidate), candidate, tolerance).where("ok"))


def repaired(source: DataFrame, output: DataFrame, tolerance: int, mapping: DataFrame | None = None, answered: DataFrame | None = None) -> DataFrame:
    """(chunk, pos, timecode, text, way) of the source blocks of all chunks that are valid or can be repaired.

    way: as it is, position, subset, anchors or mapping. mapping: (chunk, at, output_pos, source_pos), and answered the
    chunks that have one, for the chunks that no strategy repairs. Chunks left out are told by unresolved().
    Each step's open chunks are kept as a table, and the next step sees only these.
    """
    good = kept(align.problems(source, output, tolerance).where("ok").select("chunk"))
    first = align.first_of(only(output, good), ["chunk", "timecode"], "pos").select("chunk", "timecode", "text")
    as_is = only(source, good).join(first, ["chunk", "timecode"], "left").select("chunk", "pos", "timecode", F.coalesce("text", F.lit("")).alias("text"))
    done = as_is.withColumn("way", F.lit("as it is"))
    s, o = kept(without(source, good)), kept(without(output, good))
    rest = s, o
    winners = None
    for way, answer in (("position", align.by_position), ("subset", align.by_timecode_subset), ("anchors", lambda a, b: align.by_anchors(a, b, tolerance))):
        found = kept(answer(*rest).select(*ROW).withColumn("way", F.lit(way)))
        winners = found if winners is None else winners.unionByName(found)
        rest = kept(without(rest[0], found)), kept(without(rest[1], found))
    sound = kept(valid(s, winners, tolerance))
    done = done.unionByName(sound)
    if mapping is not None:
        failed_s, failed_o = kept(without(s, sound)), kept(without(o, sound))
        pairs = kept(only(mapping, failed_s))
        mapped = kept(align.by_mapping(failed_s, failed_o, pairs, pairs if answered is None else only(answered, failed_s)).select(*ROW))
        done = done.unionByName(valid(failed_s, mapped, tolerance).withColumn("way", F.lit("mapping")))
    return done


def unresolved(source: DataFrame, output: DataFrame, tolerance: int, rows: DataFrame) -> DataFrame:
    """(chunk, error) of the chunks that rows, from repaired(), lacks."""
    return without(align.problems(source, output, tolerance).where("NOT ok").select("chunk", F.col("errors").alias("error")), rows)


def backoff_seconds(attempt: int) -> int:
    """How long to wait after an attempt, from 1."""
    return 2 ** (attempt - 1)


def requests(source: DataFrame, output: DataFrame, tolerance: int) -> DataFrame:
    """(chunk, prompt) for the chunks with problems: the error, the source and the output under numbers by place."""

    def listing(rows: DataFrame, text) -> DataFrame:
        piece = F.format_string("%d\n%s\n%s", (F.col("pos") + 1).cast("bigint"), F.col("timecode"), text)
        listed = F.array_sort(F.collect_list(F.struct("pos", piece.alias("p"))))
        return rows.groupBy("chunk").agg(F.concat(F.array_join(F.transform(listed, lambda r: r["p"]), "\n\n"), F.lit("\n")).alias("listing"))

    bad = align.problems(source, output, tolerance).where("NOT ok").select("chunk", "errors")
    left = listing(only(source, bad), F.lit("")).withColumnRenamed("listing", "source")
    right = listing(only(output, bad), F.col("text")).withColumnRenamed("listing", "output")
    parts = bad.join(left, "chunk", "left").join(right, "chunk", "left")
    prompt = F.concat_ws("\n---\n", F.col("errors"), F.coalesce("source", F.lit("\n")), F.coalesce("output", F.lit("\n")))
    return parts.select("chunk", prompt.alias("prompt"))


def repair_loop(
    source: DataFrame,
    output: DataFrame,
    tolerance: int,
    ask: Callable[[DataFrame], DataFrame],
    attempts: int = 3,
    keep: Callable[[DataFrame], DataFrame] = kept,
    wait: Callable[[float], None] = time.sleep,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Asks for mappings until every chunk is valid or the attempts are used up.

    ask: (chunk, prompt) -> (chunk, raw, cost), a service called for all open chunks at once; keep stores an answer so
    that it is asked for once. A candidate that still has problems is what the next attempt starts from; an answer that
    can't be used leaves the output as it was. Returns rows (chunk, pos, timecode, text, attempt), costs (chunk, cost, attempts) of all chunks asked for and failures
    (chunk, error) with the last error.
    """
    rows, costs, open_ = None, None, keep(without(output, align.problems(source, output, tolerance).where("ok")))
    wanted = keep(without(source, align.problems(source, output, tolerance).where("ok")))
    errors = keep(align.problems(wanted, open_, tolerance).select("chunk", F.col("errors").alias("error")))
    for attempt in range(1, attempts + 1):
        answers = keep(ask(requests(wanted, open_, tolerance)).select("chunk", "raw", "cost"))
        spent = answers.select("chunk", "cost")
        costs = spent if costs is None else costs.unionByName(spent)
        told = answers.withColumn("error", mapping_error(F.col("raw")))
        usable = told.where("error IS NULL")
        mapping = mapping_rows(usable, "chunk", "raw").select("chunk", "at", F.col("output_index").alias("o"), F.col("source_index").alias("s"))
        mapping = keep(mapping.select("chunk", "at", (F.col("o") - 1).alias("output_pos"), (F.col("s") - 1).alias("source_pos")))
        candidate = keep(align.by_mapping(wanted, open_, mapping, usable).select(*ROW))
        verdict = keep(align.problems(only(wanted, candidate), candidate, tolerance))
        done = keep(only(candidate, verdict.where("ok")).withColumn("attempt", F.lit(attempt)))
        rows = done if rows is None else rows.unionByName(done)
        said = told.where("error IS NOT NULL").select("chunk", "error").unionByName(align.mapping_errors(wanted, open_, mapping))
        said = said.unionByName(verdict.where("NOT ok").select("chunk", F.col("errors").alias("error")))
        errors = keep(without(without(errors, done), said).unionByName(without(said, done)))
        next_ = without(candidate, done)
        open_ = keep(without(without(open_, done), next_).unionByName(next_))
        wanted = keep(without(wanted, done))
        if wanted.isEmpty():
            break
        if attempt < attempts:
            wait(backoff_seconds(attempt))
    total = costs.groupBy("chunk").agg(F.sum("cost").alias("cost"), F.count("*").alias("attempts"))
    return rows, total, errors
