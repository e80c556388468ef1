"""SRT documents: strict and lenient reading, writing, ASS dialogue lines and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timecode as T
from ..functions.text import clean_text, soft_breaks

#: A fixed format: the script header.
ASS_HEADER = """[Script Info]
ScriptType: v4.00+
WrapStyle: 0
ScaledBorderAndShadow: yes
YCbCr Matrix: TV.709
PlayResX: 1920
PlayResY: 1080

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,源泉圓體月 M,64,&H00FDFDFD,&H000000FF,&H00000000,&H7D000000,0,0,0,0,100,100,0,0,1,6,2,2,10,10,40,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""
ZERO = "00:00:00,000 --> 00:00:00,000"
_TRIM = r"^[\s\x{FEFF}]+|\s+$"


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, document) of SRT files, a byte order mark tolerated; project_id is the file's path."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("project_id"), F.regexp_replace("value", "^﻿", "").alias("document"))


def _pieces(documents: DataFrame, key: str, document: str) -> DataFrame:
    parts = F.split(F.regexp_replace(F.col(document), _TRIM, ""), r"\r?\n\r?\n")
    rows = documents.select(key, F.posexplode(parts).alias("ordinal", "piece"))
    return rows.withColumn("lines", F.split(F.regexp_replace("piece", r"^\s+|\s+$", ""), r"\r?\n"))


def parse(documents: DataFrame, key: str = "project_id", document: str = "document") -> DataFrame:
    """(key, pos, index, timecode, start_ms, end_ms, text); pieces of one line are skipped, bad ones raise."""
    rows = _pieces(documents, key, document).where(F.size("lines") >= 2)
    index, code = F.trim(F.get("lines", F.lit(0))), F.trim(F.get("lines", F.lit(1)))
    checked = F.when(code.rlike(T.STRICT), code).otherwise(F.raise_error(F.concat(F.lit("not a timecode: "), code)))
    number = F.coalesce(index.try_cast("int"), F.raise_error(F.concat(F.lit("not an index: "), index)).cast("int"))
    text = F.array_join(F.slice("lines", 3, F.size("lines")), "\n")
    return rows.select(key, F.col("ordinal").alias("pos"), number.alias("index"), checked.alias("timecode"), T.start_ms(code).alias("start_ms"), T.end_ms(code).alias("end_ms"), text.alias("text"))


def parse_lenient(documents: DataFrame, key: str = "project_id", document: str = "document", first: int = 1) -> DataFrame:
    """(key, index, timecode, text) of broken output: numbered by place; the first of three lines that looks like a
    timecode is one and what stands before it goes; without one all is text and the timecode zero."""
    rows = _pieces(documents, key, document).where(F.array_join("lines", "") != "")
    at = F.array_position(F.transform(F.slice("lines", 1, 3), lambda line: F.trim(line).rlike(T.LENIENT)), True).cast("int")
    code = F.when(at > 0, F.trim(F.get("lines", at - 1))).otherwise(F.lit(ZERO))
    text = F.array_join(F.when(at > 0, F.slice("lines", at + 1, F.size("lines"))).otherwise(F.col("lines")), "\n")
    return rows.select(key, (F.col("ordinal") + first).alias("index"), code.alias("timecode"), text.alias("text"))


def ranges(documents: DataFrame, key: str = "project_id", document: str = "document") -> DataFrame:
    """(key, pos, start_ms, end_ms, nth) of every line with an arrow, nth by start; a bad one raises."""
    lines = documents.select(key, F.posexplode(F.split(document, r"\r?\n")).alias("pos", "line")).where(F.contains("line", F.lit("-->")))
    start = F.coalesce(T.start_ms(F.col("line")), F.raise_error(F.concat(F.lit("not a time range: "), F.col("line"))).cast("bigint"))
    found = lines.select(key, "pos", start.alias("start_ms"), T.end_ms(F.col("line")).alias("end_ms"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("start_ms", "pos")))


def serialize(blocks: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, document) from (key, pos, index, timecode, text): pieces apart by a blank line, a final line feed."""
    piece = F.format_string("%d\n%s\n%s", F.col("index").cast("bigint"), F.col("timecode"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return blocks.groupBy(key).agg(F.concat(F.array_join(F.transform(listed, lambda r: r["piece"]), "\n\n"), F.lit("\n")).alias("document"))


def dialogue(blocks: DataFrame) -> DataFrame:
    """Adds line: the ASS dialogue line of a block with start_ms, end_ms and text."""
    parts = [F.lit("Dialogue: 0,"), T.ass_time(F.col("start_ms")), F.lit(","), T.ass_time(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), soft_breaks(clean_text(F.col("text")))]
    return blocks.withColumn("line", F.concat(*parts))


def ass_documents(blocks: DataFrame, key: str = "project_id") -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return dialogue(blocks).groupBy(key).agg(F.concat(F.lit(ASS_HEADER), F.array_join(F.transform(listed, lambda r: r["line"]), "\n"), F.lit("\n")).alias("document"))
