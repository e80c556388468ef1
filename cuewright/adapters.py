"""Driver tables as the engine's abstractions: blocks, timed tokens, intervals, glossary, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.timecode import span


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as subtitle blocks: one a line, two seconds apart, 1.5 s long."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("project_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    start = F.col("pos").cast("bigint") * 2000
    timed = lines.select("project_id", "pos", (F.col("pos") + 1).alias("index"), start.alias("start_ms"), (start + 1500).alias("end_ms"), "text")
    return timed.withColumn("timecode", span(F.col("start_ms"), F.col("end_ms")))


BLOCKS_SQL = """lines AS (SELECT doc_id AS project_id, unnest(string_split(text, chr(10))) AS text,
  unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
blocks AS (SELECT project_id, CAST(pos AS INT) AS pos, CAST(pos + 1 AS INT) AS index, 2000 * pos AS start_ms, 2000 * pos + 1500 AS end_ms, text,
  {timecode} AS timecode FROM lines)"""


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as timed words: 60 ms a character, a turn opens with a silence of its own length."""
    words = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("project_id"), "turn", F.col("role").alias("speaker_id"), F.posexplode(F.split("text", "[ \n]")).alias("w", "text")
    )
    words = words.where("text <> ''")
    first = F.row_number().over(Window.partitionBy("project_id", "turn").orderBy("w")) == 1
    silence = F.when(first, (F.col("project_id") * 7 + F.col("turn") * 13) % 5 * 300).otherwise(0)
    order = Window.partitionBy("project_id").orderBy("turn", "w")
    timed = words.withColumn("lasts", 60 * F.length("text")).withColumn("end_ms", F.sum(silence + F.col("lasts")).over(order))
    return timed.select(
        "project_id",
        (F.row_number().over(order) - 1).alias("tok_pos"),
        "text",
        ((F.col("end_ms") - F.col("lasts")) / 1000).alias("start"),
        (F.col("end_ms") / 1000).alias("end"),
        "speaker_id",
    )


def folded_sql(value: str) -> str:
    """What folded() gives for text of Latin letters that are composed already: of these only ß folds into two."""
    return f"regexp_replace(replace(lower({value}), 'ß', 'ss'), '[ー〜～・･\\s　!！?？.。,、:：/／「」『』()（）]', '', 'g')"
