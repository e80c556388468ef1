"""The last text stage: names spaced, styled and plain documents; curated names, and lists of what a glossary misses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HAN_OR_KANA, SUSPECT, clean_text, spaced_names, stripped
from ..sources import srt


def curated_names(entries: DataFrame) -> DataFrame:
    """(unit): the distinct targets of a glossary that hold both a Latin letter and Han or kana."""
    return entries.where(F.col("target").rlike("[A-Za-z]") & F.col("target").rlike(f"[{HAN_OR_KANA}]")).select(F.col("target").alias("unit")).distinct()


def name_units(curated: DataFrame, agreed: DataFrame) -> list[str]:
    """Names to space, from (unit) tables: a catalogue's size, as a pattern is compiled from them."""
    return sorted(r["unit"] for r in curated.select("unit").union(agreed.select("unit")).distinct().collect())


def foreign_terms(entries: DataFrame) -> DataFrame:
    """(term): the distinct targets that would themselves be suspect, the longest first, ties by term."""
    return entries.where(F.col("target").rlike(SUSPECT)).select(F.col("target").alias("term")).distinct().orderBy(F.length("term").desc(), "term")


def entry_counts(entries: DataFrame) -> DataFrame:
    """(kind, units, entries) of a glossary."""
    return entries.groupBy("kind").agg(F.countDistinct("unit_id").alias("units"), F.count("*").alias("entries"))


def suspect_list(blocks: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, listing): a line '- #index: text' for each block, its lines joined by blanks."""
    line = F.concat(F.lit("- #"), F.col("index").cast("string"), F.lit(": "), stripped(F.regexp_replace("text", r"\r\n|[\n\r\x{B}\x{C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", " ")))
    listed = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return blocks.groupBy(key).agg(F.array_join(F.transform(listed, lambda r: r["line"]), "\n").alias("listing"))


def finalized(blocks: DataFrame, units: Iterable[str], key: str = "project_id") -> DataFrame:
    """(key, ass, srt): the styled document and the plain one with cleaned texts, of blocks with their names spaced."""
    spaced = blocks.withColumn("text", spaced_names(F.col("text"), units))
    styled = srt.ass_documents(spaced, key).withColumnRenamed("document", "ass")
    plain = srt.serialize(spaced.withColumn("text", clean_text(F.col("text"))), key).withColumnRenamed("document", "srt")
    return styled.join(plain, key)


def merged(results: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, document): the blocks (key, chunk, pos, timecode, text) of all chunks in order, bare dash lines out, numbered from 1."""
    from pyspark.sql import Window

    from ..functions.text import without_bare_dashes

    order = Window.partitionBy(key).orderBy("chunk", "pos")
    rows = results.select(key, F.row_number().over(order).alias("index"), "timecode", without_bare_dashes(F.col("text")).alias("text"))
    return srt.serialize(rows.withColumn("pos", F.col("index")), key)


#: Fixed texts of the rendered glossary.
FULL_HEADER = "\n【固定詞彙表（完整參照表，未過濾；僅在該名稱實際出現時才套用，容許 ASR 誤聽，未出現者忽略）】\n"
FILTERED_HEADER = "\n【固定詞彙表（最高優先級，必須採用；同一行的多個別名需全部正規化為同一目標）】\n"
TALENTS, OTHERS, GROUP, ALONE = "〔藝人/組合〕", "〔節目/單元/品牌/術語〕", "・組合：", "・（單人）"


def glossary_block(entries: DataFrame, full: bool, key: str = "text_id") -> DataFrame:
    """(key, block): the header of the mode, then units under their group, then other entries; a section without any is left out.

    entries: (key, kind, unit_id, entry_pos, is_group, aliases, target).
    """
    line = F.concat(F.array_join("aliases", " / "), F.lit(" → "), F.col("target"))
    shown = F.when(F.col("is_group"), F.concat(F.lit(GROUP), line)).when(F.col("kind") == "talent", F.concat(F.lit("    · "), line)).otherwise(F.concat(F.lit("- "), line))
    rows = entries.select(key, "kind", "unit_id", "entry_pos", "is_group", shown.alias("line"))
    units = rows.where("kind = 'talent'").groupBy(key, "unit_id").agg(F.bool_or("is_group").alias("grouped"), F.array_sort(F.collect_list(F.struct("entry_pos", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda r: r["line"]), "\n")
    units = units.select(key, "unit_id", F.when(F.col("grouped"), text).otherwise(F.concat(F.lit(ALONE + "\n"), text)).alias("line"))
    listed = F.array_sort(F.collect_list(F.struct("unit_id", "line")))
    talents = units.groupBy(key).agg(F.concat(F.lit(TALENTS + "\n"), F.array_join(F.transform(listed, lambda r: r["line"]), "\n")).alias("talents"))
    listed = F.array_sort(F.collect_list(F.struct("entry_pos", "line")))
    others = rows.where("kind = 'other'").groupBy(key).agg(F.concat(F.lit(OTHERS + "\n"), F.array_join(F.transform(listed, lambda r: r["line"]), "\n")).alias("others"))
    both = talents.join(others, key, "full_outer")
    return both.select(key, F.concat(F.lit(FULL_HEADER if full else FILTERED_HEADER), F.concat_ws("\n", "talents", "others")).alias("block"))


