"""Queries over timed words (conversations as speech): utterances, blocks, rendered subtitles, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import blocks, conversation_words
from ..functions.timecode import stamp_seconds
from ..operators import segment
from ..operators.segment import Style, subtitles, wrapped
from ..operators.segment import utterances as spoken
from ..sources import srt
from .blocks import B

LATIN = Style(japanese=False, hard=".?!", soft=",;:")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(conversation_words(spark, sf_dir), LATIN)


def merge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles(conversation_words(spark, sf_dir), LATIN, "merged")


def overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles(conversation_words(spark, sf_dir), LATIN, "without_overlaps")


def wrap_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles(conversation_words(spark, sf_dir), LATIN)


def asr_to_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: words to blocks to text."""
    code = F.concat(stamp_seconds(F.col("start")), F.lit(" --> "), stamp_seconds(F.col("end")))
    return srt.serialize(wrap_render(spark, sf_dir).select("project_id", "pos", (F.col("pos") + 1).alias("index"), code.alias("timecode"), "text"))


def japanese_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words as kana runs with Japanese marks, in the Japanese style."""
    kana = F.translate(F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyzéèêñóüäöçíß", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもや"), ".,?", "。、？")
    return subtitles(conversation_words(spark, sf_dir).withColumn("text", F.regexp_replace(kana, "[A-Z]", "A")), Style())


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks' texts wrapped, however many lines that takes."""
    return blocks(spark, sf_dir).select("project_id", "pos", wrapped(F.col("text"), LATIN).alias("lines"))


def _one_of(chars) -> str:
    return "[" + "".join(c if c.isalnum() else f"\\x{{{ord(c):X}}}" for c in sorted(chars)) + "]"


_UNSAFE = f"^({_one_of(segment.NO_SPACE_BEFORE)}|{_one_of(segment.BOUND_KANA)}|{'|'.join(segment.UNSAFE_STARTS)})"
_LAST, _NEXT = "rest[i:i]", "rest[i + 1:]"
_WORTH = f"""CASE WHEN contains('{segment.HARD}', {_LAST}) THEN 40 WHEN contains('{segment.SOFT}', {_LAST}) THEN 30 WHEN contains('{"".join(sorted(segment.BREAK_AFTER))}', {_LAST}) THEN 15 ELSE 0 END
  - CASE WHEN NOT contains('{segment.HARD}{segment.SOFT}', {_LAST}) AND regexp_matches({_NEXT}, '{_UNSAFE}') THEN 50 ELSE 0 END - CASE WHEN least(i, n - i) <= 3 THEN 30 WHEN least(i, n - i) <= 6 THEN 5 ELSE 0 END
  - CASE WHEN regexp_matches({_LAST}, '[0-9A-Za-z]') AND regexp_matches({_NEXT}, '^[0-9A-Za-z]') THEN 80 ELSE 0 END - abs(i - n / 2::DOUBLE) / 2"""
#: A step takes the best break of what is left; ties go to the middle, then to the left.
WRAP_SQL = B + f""", walk AS (WITH RECURSIVE f AS (SELECT project_id, pos, text AS rest, '' AS done, 0 AS k FROM blocks
  UNION ALL SELECT project_id, pos, trim(rest[brk + 1:]), done || trim(rest[1:brk]) || chr(10), k + 1 FROM (SELECT *,
    -list_max(list_transform(range(CASE WHEN n <= 48 THEN greatest(1, n - 24) ELSE 1 END, least(24, n - 1) + 1), lambda i: struct_pack(w := CAST({_WORTH} AS DOUBLE), d := -abs(i - n / 2::DOUBLE), i := -i))).i AS brk
    FROM (SELECT *, length(rest) AS n FROM f) WHERE n > 24)) SELECT * FROM f)
SELECT project_id, pos, CASE WHEN rest = '' AND k > 0 THEN left(done, length(done) - 1) ELSE done || rest END AS lines FROM walk WHERE length(rest) <= 24"""

_CLOSERS, _OPENERS = "。、，,.！？?!：:；;）)\\]」』】》〉", "（(\\[「『【《〈"


def _joined(texts: str) -> str:
    return f"trim(regexp_replace(regexp_replace(array_to_string({texts}, ' '), '\\s+([{_CLOSERS}])', '\\1', 'g'), '([{_OPENERS}])\\s+', '\\1', 'g'))"


#: The cuts of one turn: from word to word, begin is where the open utterance starts.
UTTERANCES_SQL = f"""WITH split AS (SELECT conv_id, turn, role, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS text, unnest(range(len(string_split(replace(text, chr(10), ' '), ' ')))) AS w FROM conversations),
timed AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id, turn ORDER BY w) = 1 THEN (conv_id * 7 + turn * 13) % 5 * 300 ELSE 0 END AS silence, 60 * length(text) AS lasts FROM split WHERE text <> ''),
placed AS (SELECT *, CAST(sum(silence + lasts) OVER (PARTITION BY conv_id ORDER BY turn, w) AS BIGINT) AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn, w) AS n FROM timed),
opened AS (SELECT conv_id, role, n, e - lasts AS s, e, CASE WHEN length(text) > 1 AND contains('。！？?!', text[1:1]) THEN [text[1:1], text[2:]] ELSE [text] END AS bits FROM placed),
words AS (SELECT conv_id, role, n, sub, bits[sub] AS text, s, CASE WHEN sub < len(bits) THEN s ELSE e END AS e FROM (SELECT *, unnest(range(1, len(bits) + 1)) AS sub FROM opened)),
marked AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY s, e, n, sub) AND row_number() OVER (PARTITION BY conv_id ORDER BY s, e, n, sub) > 1 THEN 1 ELSE 0 END AS other FROM words),
run AS (SELECT *, sum(other) OVER (PARTITION BY conv_id ORDER BY s, e, n, sub) AS g FROM marked),
lists AS (SELECT conv_id, g, any_value(role) AS role, list(text ORDER BY s, e, n, sub) AS t, list(s ORDER BY s, e, n, sub) AS ss, list(e ORDER BY s, e, n, sub) AS ee FROM run GROUP BY 1, 2),
tails AS (SELECT *, list_transform(range(1, len(t) + 1), lambda i: list_filter(range(i, least(i + 9, len(t) + 1)), lambda j: contains('.?!', right(t[j], 1)))) AS stops FROM lists),
ready AS (SELECT * EXCLUDE stops, list_transform(range(1, len(t) + 1), lambda i: len(stops[i]) > 0 AND length(array_to_string(t[i:stops[i][1]], '')) <= 8 AND length({_joined('t[i:stops[i][1]]')}) <= 8) AS tail FROM tails),
cuts AS (WITH RECURSIVE f AS (SELECT conv_id, g, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS b FROM ready
  UNION ALL SELECT conv_id, g, i + 1, CASE WHEN NOT bound AND length(more) > 44 THEN coalesce(list_max(list_filter(range(b, i + 1), lambda k: contains('.?!,;:', right(t[k], 1)) AND {_joined('t[b:k]')} <> '')) + 1, i + 1)
    WHEN NOT bound AND ss[i + 1] - ee[i] > 700 AND NOT (contains(',;:', right(t[i], 1)) AND length(held) <= 8) AND NOT (b = i AND length(t[i]) = 1 AND NOT regexp_matches(t[i], '^[{_CLOSERS}]') AND ee[i] - ss[i] >= 600) THEN i + 1
    WHEN contains('.?!', right(t[i], 1)) OR contains(',;:', right(t[i], 1)) AND length(held) >= 24 THEN i + 1 ELSE b END
  FROM (SELECT f.*, t, ss, ee, {_joined('t[f.b:f.i]')} AS held, {_joined('t[f.b:f.i + 1]')} AS more, tail[f.i + 1] OR regexp_matches(t[f.i + 1], '^[{_CLOSERS}]') AS bound FROM f JOIN ready USING (conv_id, g) WHERE f.i < len(t))) SELECT * FROM f),
begins AS (SELECT DISTINCT conv_id, g, b FROM cuts),
parts AS (SELECT conv_id, g, b, coalesce(lead(b) OVER (PARTITION BY conv_id, g ORDER BY b) - 1, len(t)) AS z, t, ss, ee, role FROM begins JOIN ready USING (conv_id, g)),
told AS (SELECT conv_id, g, b, role, ss[b] / 1000::DOUBLE AS s, greatest(ee[z] / 1000::DOUBLE, ss[b] / 1000::DOUBLE + 0.35::DOUBLE) AS e, {_joined('t[b:z]')} AS text FROM parts)
SELECT conv_id AS project_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY g, b) - 1 AS INT) AS pos, role AS speaker_id, s AS start, e AS "end", text FROM told WHERE text <> ''"""

QUERIES = {f.__name__: f for f in (utterances, merge_blocks, overlap_merge, wrap_render, asr_to_srt, japanese_srt, wrapped_lines)}
ORACLE = {"utterances": UTTERANCES_SQL, "wrapped_lines": WRAP_SQL}
