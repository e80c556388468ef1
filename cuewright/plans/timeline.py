"""Interval queries: silence sessions, hold extension, timecodes (adapter: events as intervals)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timecode import span

GAP_MS = 6 * 3600 * 1000
HOLD_MS = 500
MIN_GAP_MS = 80


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as intervals: key user, start in ms, length value minutes."""
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "user_id", "event_id", start.alias("start_ms"), (start + F.floor(F.col("value") * 60000)).cast("bigint").alias("end_ms")
    )


def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence sessionisation: a new session where the start lies over GAP_MS behind the previous end."""
    order = Window.partitionBy("user_id").orderBy("start_ms", "event_id")
    new = (F.col("start_ms") - F.lag("end_ms").over(order) > GAP_MS).cast("int")
    runs = intervals(spark, sf_dir).withColumn("new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("new").over(order))
    return runs.groupBy("user_id", "session").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


def hold_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as subtitle blocks whose end is held HOLD_MS, yet leaves MIN_GAP_MS to the next start."""
    order = Window.partitionBy("user_id").orderBy("start_ms", "session")
    held = F.col("end_ms") + HOLD_MS
    end = F.greatest("end_ms", F.coalesce(F.least(held, F.lead("start_ms").over(order) - MIN_GAP_MS), held))
    first = F.first("start_ms").over(order)
    blocks = gap_sessions(spark, sf_dir).select("user_id", "start_ms", end.alias("end_ms"), F.row_number().over(order).alias("pos"), first.alias("origin"))
    return blocks.select(
        "user_id", "pos", (F.col("start_ms") - F.col("origin")).alias("start_ms"), (F.col("end_ms") - F.col("origin")).alias("end_ms")
    ).withColumn("timecode", span(F.col("start_ms"), F.col("end_ms")))


INTERVALS_SQL = """iv AS (SELECT user_id, event_id, epoch_us(ts)//1000 AS start_ms,
  epoch_us(ts)//1000 + CAST(floor(value*60000) AS BIGINT) AS end_ms FROM events)"""

SESSIONS_SQL = f"""{INTERVALS_SQL}, flags AS (SELECT *, coalesce(CAST(start_ms - lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) > {GAP_MS} AS INT), 0) AS new FROM iv),
runs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS BIGINT) AS session FROM flags),
sessions AS (SELECT user_id, session, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM runs GROUP BY user_id, session)"""


def timecode_sql(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', greatest({ms},0)//3600000, greatest({ms},0)//60000%60, greatest({ms},0)//1000%60, greatest({ms},0)%1000)"


QUERIES = {"gap_sessions": gap_sessions, "hold_extension": hold_extension}
ORACLE = {
    "gap_sessions": f"WITH {SESSIONS_SQL} SELECT * FROM sessions",
    "hold_extension": f"""WITH {SESSIONS_SQL}, held AS (SELECT user_id, start_ms,
  greatest(end_ms, coalesce(least(end_ms + {HOLD_MS}, lead(start_ms) OVER w - {MIN_GAP_MS}), end_ms + {HOLD_MS})) AS end_ms,
  row_number() OVER w AS pos, first_value(start_ms) OVER w AS origin FROM sessions WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, session)),
rel AS (SELECT user_id, pos, start_ms - origin AS start_ms, end_ms - origin AS end_ms FROM held)
SELECT *, {timecode_sql('start_ms')} || ' --> ' || {timecode_sql('end_ms')} AS timecode FROM rel""",
}
