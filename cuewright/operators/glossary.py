"""Dictionary matching: which entries occur in a text, whole units of the entries hit, rendering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, folded

#: How many aliases an automaton holds.
SHORT = 100_000
#: (characters of a gram, grams of a window): aliases as long as a window are looked up by its least gram.
TIERS = ((8, 9), (3, 1))


def least_grams(text: Column, n: int, window: int) -> Column:
    """Hashes of the least gram of n characters of each window: a text that contains an alias has those of the alias."""

    @F.pandas_udf("array<bigint>")
    def run(values: pd.Series) -> pd.Series:
        import numpy as np

        def of(text: str | None) -> list:
            if text is None:
                return []
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            if len(points) < n + window - 1:
                return []
            h = np.zeros(len(points) - n + 1, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(h)]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            return np.unique(np.lib.stride_tricks.sliding_window_view(h, window).min(1)).view(np.int64)

        return values.map(of)

    return run(text)


def scanned(texts: DataFrame, names: list[tuple[int, str]]) -> DataFrame:
    """(text_id, entry_id) of folded names in folded texts by one automaton: a pass over the texts, whatever the number of names."""
    kind = dict(texts.dtypes)["text_id"]

    def run(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        entries: dict[str, list[int]] = {}
        for entry, name in names:
            entries.setdefault(name, []).append(entry)
        for name, found in entries.items():
            automaton.add_word(name, found)
        automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = set().union(*(found for _, found in automaton.iter(fold(text)))) if text and entries else ()
                hits += own
                rows += [k] * len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.int64())], names=["text_id", "entry_id"])

    return texts.select("text_id", "hay").mapInArrow(run, f"text_id {kind}, entry_id bigint")


def alias_hits(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct (text_id, entry_id) where the folded text contains the folded alias; texts (text_id, hay), aliases (entry_id, alias).

    Both are compared as folded() has them, without case, width, kana kind, blanks and marks; aliases of
    which nothing is left match nothing. Up to SHORT aliases are looked for by one automaton. Of more, those long
    enough meet texts by an equality join on one of their grams and are then looked for; the others, of which there
    are but few kinds, are scanned for SHORT at a time.
    """
    names = aliases.select("entry_id", folded(F.col("alias")).alias("alias")).where("alias <> ''").distinct()
    if names.limit(SHORT + 1).count() <= SHORT:
        return scanned(texts, [(r["entry_id"], r["alias"]) for r in names.collect()]).distinct()
    found, longer = [], F.lit(False)
    for n, window in TIERS:
        fits = F.length("alias") >= n + window - 1
        some = names.where(fits & ~longer)
        longer = longer | fits
        wanted = some.withColumn("gram", F.element_at(least_grams(F.col("alias"), n, window), 1))
        spread = texts.select("text_id", folded(F.col("hay")).alias("hay")).select("text_id", F.explode(least_grams(F.col("hay"), n, window)).alias("gram"))
        met = spread.join(wanted, "gram").select("text_id", "entry_id", "alias").distinct()
        # only texts that share a gram are folded again: with the alias in it this stays above the join
        both = met.join(texts.select("text_id", F.col("hay").alias("raw")), "text_id").withColumn("hay", folded(F.when(F.length("alias") > 0, F.col("raw"))))
        found.append(both.where(F.contains("hay", "alias")).select("text_id", F.col("entry_id").cast("bigint").alias("entry_id")))
    short = names.where(~longer)
    parts = -(-short.count() // SHORT)
    for part in range(parts):
        some = short.where(F.pmod(F.xxhash64("entry_id", "alias"), F.lit(parts)) == part)
        found.append(scanned(texts, [(r["entry_id"], r["alias"]) for r in some.collect()]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def whole_units(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """(text_id, entry columns): every entry of each unit of which an entry was hit; unitless entries on their own.

    entries: (entry_id, unit_id, ...).
    """
    hit = hits.join(entries.select("entry_id", "unit_id"), "entry_id")
    units = hit.where("unit_id IS NOT NULL").select("text_id", "unit_id").distinct()
    together = units.join(entries, "unit_id")
    alone = hit.where("unit_id IS NULL").select("text_id", "entry_id").join(entries, "entry_id")
    return together.unionByName(alone.select(*together.columns))


def rendered(entries: DataFrame) -> DataFrame:
    """(unit_id, block): lines 'alias / alias → target', the group's first; entries: (unit_id, entry_pos, aliases, target)."""
    line = F.concat(F.array_join("aliases", " / "), F.lit(" → "), F.col("target"))
    rows = F.array_sort(F.collect_list(F.struct("entry_pos", line.alias("line"))))
    return entries.groupBy("unit_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("block"))
