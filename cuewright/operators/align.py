"""Joins of a translated stream with its source: validation, and repair by position, timecode, anchors or mapping.

source: (chunk, pos, timecode); output: (chunk, pos, timecode, text); positions from 0 within a chunk.
Repairs return (chunk, pos, timecode, text) of the source blocks for the chunks that they can repair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("nth", n).where("nth = 1").drop("nth")


def left_by_key(expected: DataFrame, output: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Expected rows with the text of the first output row of equal keys, or '' where there is none."""
    first = first_of(output, keys, *order).select(*keys, text)
    return expected.join(first, keys, "left").withColumn(text, F.coalesce(text, F.lit("")))


def problems(source: DataFrame, output: DataFrame, tolerance: int) -> DataFrame:
    """(chunk, missing, unexpected, duplicated, delta, ok, errors) of each chunk, by timecodes.

    missing: source blocks without a text; unexpected: output blocks of a foreign timecode; duplicated: timecodes
    that come more than once; delta: source less output blocks. So many missing blocks and so large a delta are
    allowed. errors names what isn't, in this order; it is empty if all is well.
    """
    known = source.select("chunk", "timecode").distinct().withColumn("w", F.lit(1))
    got = output.select("chunk", "pos", "timecode").join(known, ["chunk", "timecode"], "left")
    quoted = F.concat(F.lit("'"), F.col("timecode"), F.lit("'"))
    twice = got.where("w IS NOT NULL").groupBy("chunk", "timecode").agg(F.count("*").alias("n"))
    doubles = twice.groupBy("chunk").agg(F.count("*").alias("texts"), F.count_if(F.col("n") > 1).alias("duplicated"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, quoted))).alias("dup"))
    strange = F.collect_list(F.when(F.col("w").isNull(), F.struct("pos", quoted.alias("t"))))
    counts = got.groupBy("chunk").agg(F.count("*").alias("m"), F.count_if(F.col("w").isNull()).alias("unexpected"), F.transform(F.array_sort(strange), lambda x: x["t"]).alias("foreign"))
    met = source.select("chunk", "timecode").join(twice.select("chunk", "timecode", F.lit(1).alias("o")), ["chunk", "timecode"], "left")
    wanted = met.groupBy("chunk").agg(F.count("*").alias("n"), F.count_if(F.col("o").isNull()).alias("missing"))
    both = wanted.join(counts, "chunk", "full_outer").join(doubles, "chunk", "left")
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    numbers = {c: F.coalesce(c, zero) for c in ("missing", "unexpected", "duplicated", "n", "m")}
    both = both.select("chunk", *[v.alias(k) for k, v in numbers.items()], F.coalesce("foreign", none).alias("foreign"), F.coalesce("dup", none).alias("dup"))
    both = both.withColumn("delta", F.col("n") - F.col("m"))
    said = F.concat(
        F.transform("foreign", lambda t: F.concat(F.lit("Unexpected output timecode "), t)),
        F.array_compact(
            F.array(
                F.when(F.col("duplicated") > 0, F.concat(F.lit("Duplicate output timecodes: "), F.array_join("dup", ", "))),
                F.when(F.col("missing") > tolerance, F.format_string(f"Missing %d source block(s) exceeds tolerance {tolerance}", "missing")),
                F.when(F.abs("delta") > tolerance, F.format_string(f"Output block count delta %d exceeds tolerance {tolerance} (output %d vs input %d)", "delta", "m", "n")),
            )
        ),
    )
    return both.select("chunk", "missing", "unexpected", "duplicated", "delta", (F.size(said) == 0).alias("ok"), F.array_join(said, "; ").alias("errors"))


def by_position(source: DataFrame, output: DataFrame) -> DataFrame:
    """Text by order where the counts agree."""
    equal = source.groupBy("chunk").agg(F.count("*").alias("n")).join(output.groupBy("chunk").agg(F.count("*").alias("m")), "chunk").where("n = m")
    return source.join(equal.select("chunk"), "chunk", "left_semi").join(output.select("chunk", "pos", "text"), ["chunk", "pos"]).select("chunk", "pos", "timecode", "text")


def by_timecode_subset(source: DataFrame, output: DataFrame) -> DataFrame:
    """Text by timecode where the output's timecodes are distinct, known and fewer than the source's blocks."""
    known = output.join(source.select("chunk", "timecode").distinct().withColumn("k", F.lit(1)), ["chunk", "timecode"], "left")
    sound = known.groupBy("chunk").agg(F.count("*").alias("n"), F.countDistinct("timecode").alias("d"), F.count("k").alias("k")).where("n = d AND n = k")
    partial = sound.join(source.groupBy("chunk").agg(F.count("*").alias("s")), "chunk").where("n <> s").select("chunk")
    joined = source.join(partial, "chunk", "left_semi").join(output.select("chunk", "timecode", "text"), ["chunk", "timecode"], "left")
    return joined.select("chunk", "pos", "timecode", F.coalesce("text", F.lit("")).alias("text"))


def by_anchors(source: DataFrame, output: DataFrame, tolerance: int) -> DataFrame:
    """Text by anchors of equal timecodes and, between two of them, by order.

    An anchor must lie behind the one just before it in the source too. Chunks without anchors, with a
    gap over tolerance on either side, or that nothing changes, are left out.
    """
    places = source.groupBy("chunk", "timecode").agg(F.max("pos").alias("s"))
    met = first_of(output.join(places, ["chunk", "timecode"]), ["chunk", "timecode"], "pos").select("chunk", "s", F.col("pos").alias("o"))
    order, whole = Window.partitionBy("chunk").orderBy("o"), Window.partitionBy("chunk")
    met = met.withColumn("before", F.lag("s").over(order)).where("before IS NULL OR before < s").drop("before")
    ends = source.groupBy("chunk").agg(F.count("*").alias("s")).join(output.groupBy("chunk").agg(F.count("*").alias("o")), "chunk")
    steps = met.withColumn("anchor", F.lit(True)).unionByName(ends.withColumn("anchor", F.lit(False)))
    steps = steps.select("*", F.coalesce(F.lag("s").over(order), F.lit(-1)).alias("ps"), F.coalesce(F.lag("o").over(order), F.lit(-1)).alias("po"))
    gap_s, gap_o = F.col("s") - F.col("ps") - 1, F.col("o") - F.col("po") - 1
    steps = steps.withColumn("widest", F.max(F.greatest(gap_s, gap_o)).over(whole)).withColumn("some", F.bool_or("anchor").over(whole))
    steps = steps.where(F.col("some") & (F.col("widest") <= tolerance))
    # between two anchors as many as the shorter side has, by order, then the anchor itself
    shorter = F.least(gap_s, gap_o).cast("int")
    pair = "struct<s:bigint,o:bigint>"
    inner = F.when(shorter >= 1, F.transform(F.sequence(F.lit(1), shorter), lambda j: F.struct((F.col("ps") + j).alias("s"), (F.col("po") + j).alias("o")).cast(pair)))
    own = F.when(F.col("anchor"), F.array(F.struct("s", "o").cast(pair)))
    none = F.array().cast(f"array<{pair}>")
    pairs = steps.select("chunk", F.col("o").alias("at"), F.explode(F.concat(F.coalesce(inner, none), F.coalesce(own, none))).alias("p"))
    # of two texts for one source block, which a step back may give, the later interval's stays
    placed = pairs.groupBy("chunk", F.col("p.s").alias("pos")).agg(F.max(F.struct("at", "p.o")).alias("m")).select("chunk", "pos", F.col("m.o").alias("o"))
    # nothing changes where each block already has the timecode of its place
    alike = source.select("chunk", "pos", "timecode").join(output.select("chunk", "pos", "timecode"), ["chunk", "pos", "timecode"]).groupBy("chunk").agg(F.count("*").alias("same"))
    idle = alike.join(ends.select("chunk", "s", "o"), "chunk").where("same = s AND same = o")
    good = steps.where("NOT anchor").select("chunk").join(idle.select("chunk"), "chunk", "left_anti")
    texts = output.select("chunk", F.col("pos").alias("o"), "text")
    found = source.join(good, "chunk", "left_semi").join(placed, ["chunk", "pos"], "left").join(texts, ["chunk", "o"], "left")
    return found.select("chunk", "pos", "timecode", F.coalesce("text", F.lit("")).alias("text"))


def mapping_errors(source: DataFrame, output: DataFrame, mapping: DataFrame) -> DataFrame:
    """(chunk, error): the first wrong pair, by at, of each chunk of (chunk, at, output_pos, source_pos) rows.

    A pair is wrong if it names an unknown block or a source block that an earlier pair named.
    """
    known = mapping.join(source.select("chunk", F.col("pos").alias("source_pos"), F.lit(1).alias("s")), ["chunk", "source_pos"], "left")
    known = known.join(output.select("chunk", F.col("pos").alias("output_pos"), F.lit(1).alias("t")), ["chunk", "output_pos"], "left")
    nth = F.row_number().over(Window.partitionBy("chunk", "source_pos").orderBy("at"))
    error = F.when(
        F.col("s").isNull() | F.col("t").isNull(), F.format_string("Invalid block assignment output_index=%d, source_index=%d", "output_pos", "source_pos")
    ).when(nth > 1, F.format_string("Duplicate assignment for source index %d", "source_pos"))
    found = known.select("chunk", "at", error.alias("error")).where("error IS NOT NULL")
    return found.groupBy("chunk").agg(F.min(F.struct("at", "error")).alias("m")).select("chunk", "m.error")


def by_mapping(source: DataFrame, output: DataFrame, mapping: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """Text by (chunk, at, output_pos, source_pos) rows, '' where no pair names a block; chunks with mapping_errors are left out.

    answered: the chunks (chunk) that have a mapping, which may be empty; without it those with rows.
    """
    chunks = (mapping if answered is None else answered).select("chunk").distinct().join(mapping_errors(source, output, mapping), "chunk", "left_anti")
    texts = mapping.join(output.select("chunk", F.col("pos").alias("output_pos"), "text"), ["chunk", "output_pos"]).select("chunk", F.col("source_pos").alias("pos"), "text")
    joined = source.join(chunks, "chunk", "left_semi").join(texts, ["chunk", "pos"], "left")
    return joined.select("chunk", "pos", "timecode", F.coalesce("text", F.lit("")).alias("text"))


def structural_errors(source: DataFrame, candidate: DataFrame) -> DataFrame:
    """(chunk, pos, error): where a candidate departs from its source in count, index, timecode or has an empty text.

    Both: (chunk, pos, index, timecode, text). Positions beyond the shorter side only show in the count.
    """
    a, b = source.alias("a"), candidate.alias("b")
    zipped = a.join(b, (F.col("a.chunk") == F.col("b.chunk")) & (F.col("a.pos") == F.col("b.pos")))

    def error(condition: Column, name: str) -> Column:
        return F.when(condition, F.lit(name))

    found = zipped.select(
        F.col("a.chunk").alias("chunk"),
        F.col("a.pos").cast("bigint").alias("pos"),
        F.explode(
            F.array_compact(
                F.array(
                    error(F.col("a.index") != F.col("b.index"), "index"),
                    error(F.col("a.timecode") != F.col("b.timecode"), "timecode"),
                    error(F.trim(F.col("b.text")) == "", "empty"),
                )
            )
        ).alias("error"),
    )
    n = source.groupBy("chunk").agg(F.count("*").alias("n")).join(candidate.groupBy("chunk").agg(F.count("*").alias("m")), "chunk", "full_outer")
    counts = n.where(~F.col("n").eqNullSafe(F.col("m"))).select("chunk", F.lit(-1).cast("bigint").alias("pos"), F.lit("count").alias("error"))
    return found.unionByName(counts)


def first_choice(*choices: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first of several sources that has rows for a key; all of that source's rows."""
    out = choices[0]
    for more in choices[1:]:
        out = out.unionByName(more.join(out.select(*keys).distinct(), keys, "left_anti"))
    return out
