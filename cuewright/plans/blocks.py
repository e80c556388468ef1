"""Queries over subtitle blocks (documents as blocks): codec, clean-up, chunking, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import BLOCKS_SQL, blocks, folded_sql, table
from ..functions import text as X
from ..functions import timecode as T
from ..operators import chunking, ranges, segment
from ..sources import srt
from .timeline import INTERVALS_SQL, intervals, timecode_sql

LIMIT = 1500
B = "WITH " + BLOCKS_SQL.format(timecode=timecode_sql("2000 * pos") + " || ' --> ' || " + timecode_sql("(2000 * pos + 1500)"))
WS = "[\\t\\n\\v\\f\\r ]"


def parse_timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("timecode")
    rows = blocks(spark, sf_dir).select("project_id", "pos", "timecode", T.start_ms(code).alias("from_ms"), T.end_ms(code).alias("to_ms"), T.is_timecode(code).alias("ok"))
    return rows.select("*", T.ass_time(F.col("from_ms")).alias("ass_start"), T.ass_time(F.col("to_ms")).alias("ass_end"))


PARSE_SQL = B + """ SELECT project_id, pos, timecode, start_ms AS from_ms, end_ms AS to_ms, true AS ok,
printf('%d:%02d:%02d.%02d', start_ms//3600000, start_ms//60000%60, start_ms//1000%60, start_ms%1000//10) AS ass_start,
printf('%d:%02d:%02d.%02d', end_ms//3600000, end_ms//60000%60, end_ms//1000%60, end_ms%1000//10) AS ass_end FROM blocks"""


def reindex_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank blocks numbered anew from 1."""
    kept = blocks(spark, sf_dir).where(F.regexp_replace("text", r"\s", "") != "")
    order = Window.partitionBy("project_id").orderBy("pos")
    return kept.select("project_id", F.row_number().over(order).alias("index"), F.col("index").alias("was"), "text")


def block_char_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw characters of each project, its chunk count and characters a chunk."""
    raw = F.length(F.concat(F.col("index").cast("string"), F.lit("\n"), F.col("timecode"), F.lit("\n"), F.col("text")))
    sums = blocks(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("n_blocks"), F.sum(raw).alias("total"))
    n = F.greatest(F.lit(1).cast("bigint"), F.floor((F.col("total") + (LIMIT - 1)) / LIMIT))
    return sums.select("*", n.alias("n_chunks")).select("*", F.floor(F.col("total") / F.col("n_chunks")).alias("per_chunk"))


STATS_SQL = B + f""", s AS (SELECT project_id, count(*) AS n_blocks, CAST(sum(length(CAST(index AS VARCHAR) || chr(10) || timecode || chr(10) || text)) AS BIGINT) AS total FROM blocks GROUP BY 1)
SELECT *, greatest(1, (total + {LIMIT - 1}) // {LIMIT}) AS n_chunks, total // greatest(1, (total + {LIMIT - 1}) // {LIMIT}) AS per_chunk FROM s"""


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks(spark, sf_dir).withColumn("size", F.length("text") + 32)
    return found.join(chunking.chunk_numbers(found, "project_id", "pos", "size", LIMIT), ["project_id", "pos"])


def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir).select("project_id", "pos", "chunk")


def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.bounds(chunked(spark, sf_dir), ["project_id", "chunk"], "pos")


CHUNK_CTE = B + f""", sized AS (SELECT *, CAST(length(text) + 32 AS BIGINT) AS size FROM blocks),
per AS (SELECT project_id, CAST(sum(size) AS BIGINT) AS total, count(*) AS rows, greatest(1, (CAST(sum(size) AS BIGINT) + {LIMIT - 1}) // {LIMIT}) AS n FROM sized GROUP BY 1),
fold AS (WITH RECURSIVE f AS (
  SELECT s.project_id, s.pos, CAST(0 AS BIGINT) AS chunk, CASE WHEN size * n >= total AND n > 1 THEN 0 ELSE size END AS held, CASE WHEN size * n >= total AND n > 1 THEN CAST(1 AS BIGINT) ELSE 0 END AS closed
  FROM sized s JOIN per USING (project_id) WHERE pos = 0
  UNION ALL
  SELECT s.project_id, s.pos, f.closed, CASE WHEN (held + size) * n >= total AND f.closed < n - 1 THEN 0 ELSE held + size END, f.closed + CAST((held + size) * n >= total AND f.closed < n - 1 AS BIGINT)
  FROM f JOIN sized s ON s.project_id = f.project_id AND s.pos = f.pos + 1 JOIN per ON per.project_id = s.project_id)
  SELECT project_id, pos, chunk FROM f),
chunks AS (SELECT s.*, CASE WHEN n >= rows THEN CAST(s.pos AS BIGINT) ELSE fold.chunk END AS chunk FROM sized s JOIN per USING (project_id) JOIN fold USING (project_id, pos))"""


def segment_summary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's summary by its exact first and last index; every third chunk has none."""
    found = chunk_bounds(spark, sf_dir).select("project_id", "chunk", "from_index", "to_index")
    listed = found.where(F.col("chunk") % 3 != 2).select("project_id", "from_index", "to_index", F.format_string("%d-%d", "from_index", "to_index").alias("summary"))
    return found.join(listed, ["project_id", "from_index", "to_index"], "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean-up of lines given marks of every kind first."""
    marked = F.concat(F.lit("\u00a0\u2003－ "), F.col("text"), F.lit(" ，x。 」...… ！ y。\u00a0"))
    return blocks(spark, sf_dir).select("project_id", "pos", X.clean_text(marked).alias("clean"))


def _cleaned_sql(value: str) -> str:
    white = " \t\v\f\r\u00a0\u3000\u2003"  # those that occur
    steps = ((f"^[{white}，、；。]+|[{white}，、；。]+$", ""), ("^[ \t　]*[-‐-―−－][ \t　]*", "-"), (r"(\.{3,}|[…⋯])+", "…"), (f"[{white}，、；。]+([」』])", r"\1"), (r"[ \t　]*([，、；。：！？])[ \t　]*", r"\1"))
    for pattern, by in steps:
        value = f"regexp_replace({value}, '{pattern}', '{by}', 'g')"
    return f"replace({value}, '。', '，')"


def dash_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("-\n"), F.replace("text", F.lit(". "), F.lit("\n - \n")))
    return table(spark, sf_dir, "documents").select("doc_id", X.without_bare_dashes(noisy).alias("clean"))


def suspect_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that hold a run of two Latin letters once the terms are out."""
    return blocks(spark, sf_dir).where(X.is_suspect(F.col("text"), ("the", "of", "de", "la"))).select("project_id", "pos")


def strict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as SRT documents and parsed again."""
    back = srt.parse(srt.serialize(blocks(spark, sf_dir)))
    return back.select("project_id", "index", "timecode", "start_ms", "end_ms", F.col("text"))


def ass_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.dialogue(blocks(spark, sf_dir)).select("project_id", "pos", "line")


def name_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names put among the sentences of a line, misspaced in several ways, spaced canonically."""
    mixed = F.concat(F.lit("字Long  Coat9 "), F.replace("text", F.lit(". "), F.lit("。 TwoTribe\t漢Ｔ")), F.lit("漢 Q醬  Long Coat Two Tribe"))
    return blocks(spark, sf_dir).select("project_id", "pos", X.spaced_names(mixed, ["Two Tribe", "Long Coat", "Coat", "Q醬"]).alias("spaced"))


def resume_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose content key isn't cached; cached are those of even projects."""
    keyed = blocks(spark, sf_dir).select("project_id", "pos", ranges.content_key(F.col("timecode"), F.col("text")).alias("key"))
    return ranges.missing_work(keyed, keyed.where("project_id % 2 = 0"), "key")


def normalize_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.folded(F.col("text")).alias("folded"))


def overlap_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals as blocks of one project a user, overlaps resolved: cut short, or pushed where too little would stay."""
    by_user = Window.partitionBy("user_id")
    rows = intervals(spark, sf_dir).withColumn("origin", F.min("start_ms").over(by_user))
    moved = rows.select(F.col("user_id").alias("project_id"), (F.row_number().over(by_user.orderBy("start_ms", "event_id")) - 1).alias("pos"), (F.col("start_ms") - F.col("origin")).alias("start_ms"), (F.col("end_ms") - F.col("origin")).alias("end_ms"))
    return segment.resolved(moved, 600_000)


RESOLVE_SQL = f"""WITH {INTERVALS_SQL}, b AS (SELECT user_id AS project_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) - 1 AS INT) AS pos, start_ms - min(start_ms) OVER (PARTITION BY user_id) AS start_ms, end_ms - min(start_ms) OVER (PARTITION BY user_id) AS end_ms FROM iv),
walk AS (WITH RECURSIVE f AS (SELECT project_id, pos, start_ms AS a, end_ms AS e, CAST(NULL AS BIGINT) AS shortened FROM b WHERE pos = 0
  UNION ALL SELECT b.project_id, b.pos, CASE WHEN b.start_ms >= f.e OR b.start_ms - f.a >= 600000 THEN b.start_ms ELSE f.e END,
    CASE WHEN b.start_ms >= f.e OR b.start_ms - f.a >= 600000 OR b.end_ms > f.e THEN b.end_ms ELSE f.e + 600000 END, CASE WHEN b.start_ms < f.e AND b.start_ms - f.a >= 600000 THEN b.start_ms END
  FROM f JOIN b ON b.project_id = f.project_id AND b.pos = f.pos + 1) SELECT * FROM f)
SELECT project_id, pos, a AS start_ms, coalesce(lead(shortened) OVER (PARTITION BY project_id ORDER BY pos), e) AS end_ms FROM walk"""


QUERIES = {
    f.__name__: f
    for f in (parse_timecode, reindex_blocks, block_char_stats, chunk_budget, chunk_bounds, segment_summary_lookup, clean_text, dash_line_filter, suspect_blocks)
} | {"srt_roundtrip": strict_roundtrip, "ass_dialogue": ass_dialogue, "name_spacing": name_spacing, "resume_worklist": resume_worklist, "normalize_fold": normalize_fold, "overlap_resolve": overlap_resolve}

ORACLE = {
    "overlap_resolve": RESOLVE_SQL,
    "normalize_fold": f"SELECT doc_id, {folded_sql('text')} AS folded FROM documents",
    # a term is a whole run of Latin letters, so taking it out joins nothing
    "suspect_blocks": B + " SELECT project_id, pos FROM blocks WHERE len(list_filter(regexp_extract_all(text, '[A-Za-zぁ-ゖァ-ヺー]+'), lambda r: NOT list_contains(['the', 'of', 'de', 'la'], r) AND regexp_matches(r, '[A-Za-z]{2,}|[ぁ-ゖァ-ヺー]{2,}'))) > 0",
    "name_spacing": B + " SELECT project_id, pos, '字 Long Coat9 ' || replace(text, '. ', '。Two Tribe 漢Ｔ') || '漢 Q醬 Long Coat Two Tribe' AS spaced FROM blocks",
    "parse_timecode": PARSE_SQL,
    "reindex_blocks": B + " SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY pos) AS INT) AS index, index AS was, text FROM blocks WHERE regexp_replace(text, '\\s', '', 'g') <> ''",
    "block_char_stats": STATS_SQL,
    "chunk_budget": CHUNK_CTE + " SELECT project_id, pos, chunk FROM chunks",
    "chunk_bounds": CHUNK_CTE + " SELECT project_id, chunk, min(index) AS from_index, max(index) AS to_index, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM chunks GROUP BY 1, 2",
    "segment_summary_lookup": CHUNK_CTE + " SELECT project_id, chunk, min(index) AS from_index, max(index) AS to_index, CASE WHEN chunk % 3 <> 2 THEN min(index) || '-' || max(index) ELSE '' END AS summary FROM chunks GROUP BY 1, 2",
    "clean_text": B + f" SELECT project_id, pos, {_cleaned_sql(chr(39) + chr(160) + chr(0x2003) + '－ ' + chr(39) + ' || text || ' + chr(39) + ' ，x。 」...… ！ y。' + chr(160) + chr(39))} AS clean FROM blocks",
    "dash_line_filter": "SELECT doc_id, array_to_string(list_filter(string_split('-' || chr(10) || replace(text, '. ', chr(10) || ' - ' || chr(10)), chr(10)), lambda l: trim(l, ' ' || chr(9)) <> '-'), chr(10)) AS clean FROM documents",
    "srt_roundtrip": B + f", tidy AS (SELECT *, regexp_replace(text, '{WS}+$', '') AS t FROM blocks) SELECT project_id, index, timecode, start_ms, end_ms, t AS text FROM tidy",
    "ass_dialogue": B + f" SELECT project_id, pos, 'Dialogue: 0,' || printf('%d:%02d:%02d.%02d', start_ms//3600000, start_ms//60000%60, start_ms//1000%60, start_ms%1000//10) || ',' || printf('%d:%02d:%02d.%02d', end_ms//3600000, end_ms//60000%60, end_ms//1000%60, end_ms%1000//10) || ',Default,,0,0,0,,' || {_cleaned_sql('text')} AS line FROM blocks",
    "resume_worklist": B + ", k AS (SELECT project_id, pos, sha256(timecode || chr(31) || text) AS key FROM blocks) SELECT * FROM k WHERE key NOT IN (SELECT key FROM k WHERE project_id % 2 = 0)",
}
