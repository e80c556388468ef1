"""Alignment, glossary, cost, range and payload queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import folded_sql, table
from ..functions import text as X
from ..operators import align, costs, glossary, payloads, ranges
from .timeline import INTERVALS_SQL, intervals

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
ORDER_SQL = ", ".join(ORDER)


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 64).alias("chunk"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").withColumn("text", F.format_string("%d/%d", "l_partkey", "l_suppkey"))


def validate_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.left_by_key(expected(spark, sf_dir), lines(spark, sf_dir), ["o_orderkey"], ORDER, "text")
    return found.select("chunk", "o_orderkey", "text")


def missing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without lines, listed for each chunk of 64 order keys."""
    rest = expected(spark, sf_dir).join(lines(spark, sf_dir), "o_orderkey", "left_anti")
    return rest.groupBy("chunk").agg(F.count("*").alias("missing"), F.array_join(F.array_sort(F.collect_set(F.format_string("%012d", "o_orderkey"))), ",").alias("keys"))


def unexpected_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders that are still pending, which are not expected."""
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return lines(spark, sf_dir).join(known, "o_orderkey", "left_anti").groupBy("o_orderkey").agg(F.count("*").alias("n"))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("o_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


# ---- a source stream and an altered copy: chunks of consecutive event ids ---------------------------


def stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events in chunks of ten as blocks, and an output that lacks, repeats, renames and swaps some."""
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("chunk"), (F.col("event_id") % 10).cast("int").alias("pos"), "event_id", "user_id")
    code = F.format_string("%08d", "event_id")
    source = rows.select("chunk", "pos", code.alias("timecode"))
    kept = rows.where(~((F.col("user_id") % 7 == 0) & (F.col("chunk") % 4 == 1)))
    place = F.when(F.col("chunk") % 4 == 3, F.when(F.col("pos") == 4, 5).when(F.col("pos") == 5, 4).otherwise(F.col("pos"))).otherwise(F.col("pos"))
    named = F.when((F.col("chunk") % 4 == 2) & (F.col("user_id") % 5 == 0), F.concat(F.lit("x"), code)).otherwise(code)
    output = kept.select("chunk", (F.row_number().over(Window.partitionBy("chunk").orderBy(place)) - 1).alias("pos"), named.alias("timecode"), F.format_string("t%d", "user_id").alias("text"))
    return source, output


STREAM_SQL = """ev AS (SELECT event_id//10 AS chunk, CAST(event_id%10 AS INT) AS pos, event_id, user_id, printf('%08d', event_id) AS code FROM events),
source AS (SELECT chunk, pos, code AS timecode FROM ev),
output AS (SELECT chunk, CAST(row_number() OVER (PARTITION BY chunk ORDER BY CASE WHEN chunk%4=3 THEN CASE pos WHEN 4 THEN 5 WHEN 5 THEN 4 ELSE pos END ELSE pos END) - 1 AS INT) AS pos,
  CASE WHEN chunk%4=2 AND user_id%5=0 THEN 'x' || code ELSE code END AS timecode, 't' || user_id AS text FROM ev WHERE NOT (user_id%7=0 AND chunk%4=1)),
nout AS (SELECT chunk, count(*) AS m FROM output GROUP BY 1), nsrc AS (SELECT chunk, count(*) AS n FROM source GROUP BY 1)"""


def problems_sql(tolerance: int) -> str:
    return """known AS (SELECT DISTINCT chunk, timecode FROM source), got AS (SELECT o.chunk, o.pos, chr(39) || o.timecode || chr(39) AS t, k.timecode IS NULL AS strange FROM output o LEFT JOIN known k ON k.chunk = o.chunk AND k.timecode = o.timecode),
twice AS (SELECT chunk, t, count(*) AS c FROM got WHERE NOT strange GROUP BY 1, 2), doubles AS (SELECT chunk, count(*) FILTER (c > 1) AS duplicated, string_agg(t, ', ' ORDER BY t) FILTER (c > 1) AS dup FROM twice GROUP BY 1),
strangers AS (SELECT chunk, count(*) AS m, count(*) FILTER (strange) AS unexpected, string_agg('Unexpected output timecode ' || t, '; ' ORDER BY pos) FILTER (strange) AS said FROM got GROUP BY 1),
lacking AS (SELECT s.chunk, count(*) AS n, count(*) FILTER (c IS NULL) AS missing FROM source s LEFT JOIN twice t ON t.chunk = s.chunk AND t.t = chr(39) || s.timecode || chr(39) GROUP BY 1),
sums AS (SELECT chunk, coalesce(missing, 0) AS missing, coalesce(unexpected, 0) AS unexpected, coalesce(duplicated, 0) AS duplicated, coalesce(n, 0) - coalesce(m, 0) AS delta, coalesce(n, 0) AS n, coalesce(m, 0) AS m, said, dup
  FROM lacking FULL JOIN strangers USING (chunk) LEFT JOIN doubles USING (chunk)),
told AS (SELECT *, concat_ws('; ', said, 'Duplicate output timecodes: ' || dup, CASE WHEN missing > {t} THEN printf('Missing %d source block(s) exceeds tolerance {t}', missing) END,
  CASE WHEN abs(delta) > {t} THEN printf('Output block count delta %d exceeds tolerance {t} (output %d vs input %d)', delta, m, n) END) AS errors FROM sums),
problems AS (SELECT chunk, missing, unexpected, duplicated, delta, errors = '' AS ok, errors FROM told)""".replace("{t}", str(tolerance))


def position_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.by_position(*stream(spark, sf_dir))


def subset_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.by_timecode_subset(*stream(spark, sf_dir))


def anchor_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.by_anchors(*stream(spark, sf_dir), 2)


ANCHOR_STEPS = """places AS (SELECT chunk, timecode, max(pos) AS s FROM source GROUP BY 1, 2),
met AS (SELECT o.chunk, s, min(o.pos) AS o FROM output o JOIN places USING (chunk, timecode) GROUP BY 1, 2),
up AS (SELECT * FROM (SELECT *, lag(s) OVER (PARTITION BY chunk ORDER BY o) AS b FROM met) WHERE b IS NULL OR b < s),
steps AS (SELECT *, coalesce(lag(s) OVER w, -1) AS ps, coalesce(lag(o) OVER w, -1) AS po FROM (
  SELECT chunk, s, o, true AS anchor FROM up UNION ALL SELECT chunk, n, m, false FROM nsrc JOIN nout USING (chunk) WHERE chunk IN (SELECT chunk FROM up)) WINDOW w AS (PARTITION BY chunk ORDER BY o)),
fine AS (SELECT chunk FROM steps GROUP BY 1 HAVING max(greatest(s - ps - 1, o - po - 1)) <= 2),
placed AS (SELECT chunk, s, max(struct_pack(k := ap, o := o)).o AS o FROM (
  SELECT chunk, o AS ap, s, o FROM steps WHERE anchor UNION ALL
  SELECT chunk, o AS ap, ps + j, po + j FROM (SELECT *, unnest(range(1, CAST(greatest(least(s - ps - 1, o - po - 1), 0) + 1 AS BIGINT))) AS j FROM steps)) GROUP BY 1, 2),
found AS (SELECT s.chunk, s.pos, s.timecode, coalesce(o.text, '') AS text FROM source s JOIN fine USING (chunk) LEFT JOIN placed p ON p.chunk = s.chunk AND p.s = s.pos LEFT JOIN output o ON o.chunk = s.chunk AND o.pos = p.o),
idle AS (SELECT f.chunk FROM found f JOIN output p ON f.chunk = p.chunk AND f.pos = p.pos AND f.timecode = p.timecode AND f.text = p.text JOIN nsrc ON nsrc.chunk = f.chunk JOIN nout ON nout.chunk = f.chunk GROUP BY f.chunk, n, m HAVING count(*) = n AND n = m)"""
ANCHOR_SQL = f"WITH {STREAM_SQL}, {ANCHOR_STEPS} SELECT * FROM found WHERE chunk NOT IN (SELECT chunk FROM idle)"


def assignment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping that arrives as noisy JSON, applied."""
    source, output = stream(spark, sf_dir)
    pair = F.struct(F.col("pos").alias("output_index"), ((F.col("pos") + F.col("chunk") % 3) % 10).cast("int").alias("source_index"))
    said = output.groupBy("chunk").agg(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array_sort(F.collect_list(pair)).alias("assignments"))), F.lit("\n``` done")).alias("raw"))
    mapping = payloads.mapping_rows(said, "chunk", "raw").select("chunk", "at", F.col("output_index").alias("output_pos"), F.col("source_index").alias("source_pos"))
    return align.by_mapping(source, output, mapping)


def structural_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, output = stream(spark, sf_dir)
    index = (F.col("pos") + 1).alias("index")
    return align.structural_errors(source.select("*", index, F.lit("x").alias("text")), output.select("chunk", "pos", "timecode", F.when(F.col("pos") % 9 == 8, "").otherwise(F.col("text")).alias("text"), index))


def validation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.problems(*stream(spark, sf_dir), 1)


def coalesce_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the checked version if there is one, else of the refined, else of the translated."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    by = [rows.where(F.col("l_returnflag") == flag) for flag in "ARN"]
    return align.first_choice(*by, keys=["l_orderkey"])


# ---- glossary -----------------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as entries: the item's text as its alias, units of ten items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry_id"), F.floor(F.col("item_id") / 10).alias("unit_id"), F.col("text").alias("alias"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.col("text").alias("hay"))


ENTRIES_SQL = "entries AS (SELECT item_id AS entry_id, item_id // 10 AS unit_id, text AS alias FROM benchmark)"
HITS_SQL = f"{ENTRIES_SQL}, hits AS (SELECT doc_id AS text_id, entry_id FROM (SELECT doc_id, {folded_sql('text')} AS hay FROM documents) JOIN (SELECT entry_id, {folded_sql('alias')} AS a FROM entries) ON a <> '' AND contains(hay, a))"


def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.alias_hits(_texts(spark, sf_dir), _entries(spark, sf_dir).select("entry_id", "alias"))


def glossary_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.whole_units(_entries(spark, sf_dir), glossary_hits(spark, sf_dir)).select("text_id", "unit_id", "entry_id", "alias")


def glossary_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir).select("unit_id", F.col("entry_id").alias("entry_pos"), F.array("alias", F.lower("alias")).alias("aliases"), F.format_string("z%d", "entry_id").alias("target"))
    return glossary.rendered(rows)


# ---- costs --------------------------------------------------------------------------------------


def cost_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("amount"))
    return costs.ledger(events, "user_id", "event_type", "amount").withColumn("total", F.col("total").cast("decimal(18,2)"))


def model_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as calls of two models and of one without a price; some think."""
    model = F.when(F.col("l_returnflag") == "A", "gemini-3.1-flash-lite-preview").when(F.col("l_returnflag") == "N", "gemini-3-flash-preview").otherwise("another")
    rows = costs.priced(table(spark, sf_dir, "lineitem").withColumn("model", model), "model")
    prompt, cached, output = F.col("l_extendedprice").cast("bigint"), F.col("l_quantity").cast("bigint"), F.col("l_linenumber") * 100
    thinking = F.nullif(F.col("l_suppkey") % 50, F.lit(0))
    cost = costs.token_cost(prompt, cached, output, thinking, (F.col("p_in"), F.col("p_hit"), F.col("p_out")))
    repair = costs.repair_cost(cached, prompt, output)
    return rows.groupBy("model").agg(
        F.sum(F.rint(cost * 1e9).cast("bigint")).alias("nano_usd"), F.sum(F.rint(repair * 1e9).cast("bigint")).alias("repair_nano_usd"), F.count("*").alias("calls")
    )


def asr_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: a stated duration for two of three, else the latest end of a turn, and the price."""
    word = F.struct(F.lit("w").alias("text"), F.col("turn").cast("double").alias("start"), (F.length("text") / 16 - F.col("turn") * 10).alias("end"))
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(word).alias("words"))
    stated = F.when(F.col("conv_id") % 3 > 0, (F.col("conv_id") - 20).cast("double"))
    payload = said.select("conv_id", F.to_json(F.struct(stated.alias("audio_duration_secs"), "words")).alias("payload"))
    seconds = costs.speech_seconds(F.from_json("payload", payloads.ASR)["audio_duration_secs"], payloads.word_items(F.col("payload")))
    rows = payload.select("conv_id", seconds.alias("seconds"))
    return rows.select("conv_id", "seconds", F.round(costs.speech_cost(F.col("seconds")), 8).alias("cost"))


def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each block of 512 order keys: cost of failed ones included, retries, failures listed."""
    rows = table(spark, sf_dir, "orders").withColumn("chunk", F.floor(F.col("o_orderkey") / 512))
    failed = F.col("o_orderstatus") == "F"
    return rows.groupBy("chunk").agg(
        F.sum(F.rint(F.col("o_totalprice") * 100).cast("bigint")).alias("cost_cents"),
        F.sum(F.length("o_orderpriority")).alias("retries"),
        F.count_if(~failed).alias("completed"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(failed, F.format_string("%012d", "o_orderkey")))), ","), 256).alias("failures"),
    )


# ---- ranges -------------------------------------------------------------------------------------

STEP = 2 * 3600 * 1000


def interval_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    return rows.select("event_id", F.explode(ranges.lattice(F.col("start_ms"), F.col("end_ms"), STEP, False, True)).alias("at_ms"))


def even_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir)
    return rows.select("event_id", F.posexplode(ranges.even_points((F.col("end_ms") - F.col("start_ms")).cast("double"), 3)).alias("k", "at"))


def rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_user = Window.partitionBy("user_id")
    rows = intervals(spark, sf_dir).withColumn("origin", F.min("start_ms").over(by_user))
    moved = rows.select("user_id", "event_id", (F.col("start_ms") - F.col("origin")).alias("start_ms"), (F.col("end_ms") - F.col("origin")).alias("end_ms"))
    return moved.withColumn("duration", F.max("end_ms").over(by_user) + 1000).withColumnRenamed("event_id", "pos")


def midpoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.split_points(rebased(spark, sf_dir), "user_id", "duration")


SPLIT_SQL = f"""WITH {INTERVALS_SQL}, r AS (SELECT user_id, event_id AS pos, start_ms - min(start_ms) OVER u AS start_ms, end_ms - min(start_ms) OVER u AS end_ms FROM iv WINDOW u AS (PARTITION BY user_id)),
d AS (SELECT user_id, max(end_ms) + 1000 AS duration, max(end_ms) AS last FROM r GROUP BY 1),
g AS (SELECT user_id, greatest(0, coalesce(max(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS a, start_ms AS b FROM r UNION ALL SELECT user_id, greatest(last, 0), duration FROM d)
SELECT user_id, min(struct_pack(far := abs(a + b - duration), twice := a + b)).twice / 2 AS at FROM g JOIN d USING (user_id) WHERE b > a GROUP BY 1"""


def cyclic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") - 1).alias("ordinal"))
    n = items.count()
    return ranges.cyclic(items, "ordinal", n, n - 3, 7).select("p_partkey", "turn")


def role_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as headings of the turns that follow."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("head"))
    out = payloads.with_heading(rows.withColumnRenamed("role", "who"), ["conv_id"], ["turn"], F.col("who") == "user", F.col("head"))
    return out.select("conv_id", "turn", "who", "role")


STAGES = ("view", "click", "cart", "purchase", "error")


def stage_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first stage that wasn't logged by the end of the first day; users with a cheap purchase go without carts."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "value", F.col("event_type").alias("stage"))
    cheap = events.where("stage = 'purchase' AND value < 20").select("user_id", F.lit("cart").alias("stage"))
    done = events.where("ts < TIMESTAMP_NTZ '2024-01-02 00:00:00'")
    stages = spark.createDataFrame(list(enumerate(STAGES)), "stage_ord int, stage string")
    return ranges.next_stages(stages, done, "user_id", events, cheap, "purchase")


# ---- texts and payloads -------------------------------------------------------------------------


def sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", X.file_name(title).alias("name"))


def parse_source_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as those of known sites, and as ids."""
    url = F.col("url")
    site = F.element_at(F.array(F.lit("www.youtube.com"), F.lit("abema.tv"), F.lit("tver.jp"), F.lit("other.org")), (F.col("page_id") % 4 + 1).cast("int"))
    source = F.when(F.col("page_id") % 9 == 5, F.concat(F.lit("ep"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("https://"), site, F.regexp_extract(url, "^https?://[^/]+(.*)$", 1)))
    rows = table(spark, sf_dir, "pages").select("page_id", source.alias("source")).withColumn("id", X.source_id(F.col("source")))
    return rows.select("page_id", "id", X.platform(F.col("id")).alias("platform"), X.source_url(F.col("id")).alias("link"))


SOURCE_SQL = """WITH s AS (SELECT page_id, CASE WHEN page_id % 9 = 5 THEN 'ep' || page_id ELSE 'https://' || ['www.youtube.com', 'abema.tv', 'tver.jp', 'other.org'][page_id % 4 + 1] || regexp_extract(url, '^https?://[^/]+(.*)$', 1) END AS source FROM pages),
p AS (SELECT *, regexp_extract(regexp_extract(source, '^https?://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1) AS last, regexp_extract(source, '[?&]v=([^&#]+)', 1) AS v FROM s),
i AS (SELECT page_id, CASE WHEN regexp_matches(source, 'BV[a-zA-Z0-9]+') THEN regexp_extract(source, '(BV[a-zA-Z0-9]+)', 1) WHEN source LIKE '%youtube.com%' THEN 'v=' || coalesce(nullif(v, ''), nullif(last, ''))
  WHEN source LIKE '%tver.jp%' OR source LIKE '%abema.tv%' THEN last WHEN source NOT LIKE 'http%' THEN source END AS id FROM p),
k AS (SELECT *, CASE WHEN id LIKE 'BV%' THEN 'bilibili' WHEN id LIKE 'v=%' THEN 'youtube' WHEN regexp_matches(id, '^(ep|sh)[A-Za-z0-9]*$') THEN 'tver' WHEN id IS NOT NULL THEN 'abema' END AS platform FROM i)
SELECT page_id, id, platform, CASE platform WHEN 'bilibili' THEN 'https://www.bilibili.com/video/' || id WHEN 'youtube' THEN 'https://www.youtube.com/watch?v=' || substr(id, 3) WHEN 'tver' THEN 'https://tver.jp/episodes/' || id WHEN 'abema' THEN 'https://abema.tv/video/episode/' || id END AS link FROM k"""


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties from text with fences and prose round them."""
    noisy = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\n"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(X.json_object(noisy), "k bigint")["k"].alias("k"))


def asr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties packed as transcripts of words, unpacked again in time order."""
    word = F.struct(
        F.concat(F.when(F.col("event_id") % 5 == 0, F.lit("。")).otherwise(F.lit("")), F.col("event_type")).alias("text"),
        (F.col("event_id") % 97).cast("double").alias("start"),
        (F.col("event_id") % 97 + F.col("event_id") % 3 - 0.5).alias("end"),
        F.when(F.col("event_id") % 13 == 0, "audio_event").otherwise("word").alias("type"),
        F.col("event_type").alias("speaker_id"),
        F.col("event_id").alias("n"),
    )
    packed = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_id"), word.alias("w")))).alias("ws"))
    payload = packed.select("user_id", F.to_json(F.struct(F.array(F.struct(F.transform("ws", lambda x: x["w"]).alias("words"))).alias("transcripts"))).alias("payload"))
    return payloads.usable_words(payload, "user_id", "payload")


ASR_SQL = """WITH e AS (SELECT user_id, event_id, event_type, CAST(event_id % 97 AS DOUBLE) AS a, CAST(event_id % 97 + event_id % 3 - 0.5 AS DOUBLE) AS b FROM events WHERE event_id % 13 <> 0),
k AS (SELECT * FROM e WHERE b >= a),
p AS (SELECT user_id, event_id, 0 AS sub, CASE WHEN event_id % 5 = 0 THEN '。' ELSE event_type END AS text, a AS start, CASE WHEN event_id % 5 = 0 THEN a ELSE b END AS "end", event_type FROM k
 UNION ALL SELECT user_id, event_id, 1, event_type, a, b, event_type FROM k WHERE event_id % 5 = 0)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start, "end", event_id, sub) - 1 AS INT) AS tok_pos, text, start, "end", event_type AS speaker_id FROM p"""

_FUNCTIONS = (
    validate_left_join, missing_blocks, unexpected_blocks, duplicate_keys, position_canonicalize, subset_canonicalize, anchor_align, assignment_join, structural_guard, validation_problems,
    coalesce_source, glossary_hits, glossary_units, glossary_render, cost_ledger, model_cost, asr_cost, chunk_summary, interval_lattice, even_timestamps, midpoint_split, cyclic_select,
    role_fill_forward, stage_next, sanitize_filename, parse_source_id, json_extract, asr_words,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_FIRST = f"SELECT l_orderkey, l_partkey || '/' || l_suppkey AS text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER_SQL}) AS r FROM lineitem) WHERE r = 1"
ORACLE = {
    "validate_left_join": f"SELECT o_orderkey // 64 AS chunk, o_orderkey, coalesce(text, '') AS text FROM orders LEFT JOIN ({_FIRST}) ON l_orderkey = o_orderkey",
    "missing_blocks": "SELECT o_orderkey // 64 AS chunk, count(*) AS missing, string_agg(printf('%012d', o_orderkey), ',' ORDER BY o_orderkey) AS keys FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1",
    "unexpected_blocks": "SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1",
    "duplicate_keys": "SELECT l_orderkey AS o_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "position_canonicalize": f"WITH {STREAM_SQL} SELECT s.chunk, s.pos, s.timecode, text FROM source s JOIN output o ON s.chunk = o.chunk AND s.pos = o.pos JOIN nsrc ON nsrc.chunk = s.chunk JOIN nout ON nout.chunk = s.chunk WHERE n = m",
    "subset_canonicalize": f"""WITH {STREAM_SQL}, good AS (SELECT o.chunk FROM output o LEFT JOIN source s ON o.chunk = s.chunk AND o.timecode = s.timecode GROUP BY 1 HAVING count(*) = count(DISTINCT o.timecode) AND count(*) = count(s.timecode)),
part AS (SELECT chunk FROM good JOIN nsrc USING (chunk) JOIN nout USING (chunk) WHERE m < n)
SELECT s.chunk, s.pos, s.timecode, coalesce(o.text, '') AS text FROM source s JOIN part USING (chunk) LEFT JOIN output o ON o.chunk = s.chunk AND o.timecode = s.timecode""",
    "anchor_align": ANCHOR_SQL,
    "assignment_join": f"""WITH {STREAM_SQL}, map AS (SELECT chunk, pos AS op, CAST((pos + chunk % 3) % 10 AS INT) AS sp, text FROM output)
SELECT s.chunk, s.pos, s.timecode, coalesce(map.text, '') AS text FROM source s JOIN nout USING (chunk) LEFT JOIN map ON map.chunk = s.chunk AND map.sp = s.pos""",
    "structural_guard": f"""WITH {STREAM_SQL}, z AS (SELECT s.chunk, CAST(s.pos AS BIGINT) AS pos, s.timecode AS a, o.timecode AS b FROM source s JOIN output o ON s.chunk = o.chunk AND s.pos = o.pos)
SELECT chunk, pos, 'timecode' AS error FROM z WHERE a <> b UNION ALL SELECT chunk, pos, 'empty' FROM z WHERE pos % 9 = 8 UNION ALL SELECT chunk, -1, 'count' FROM nsrc FULL JOIN nout USING (chunk) WHERE n IS DISTINCT FROM m""",
    "validation_problems": f"WITH {STREAM_SQL}, {problems_sql(1)} SELECT * FROM problems",
    "coalesce_source": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag FROM (SELECT *, min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) OVER (PARTITION BY l_orderkey) AS best FROM lineitem)
WHERE CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END = best""",
    "glossary_hits": f"WITH {HITS_SQL} SELECT DISTINCT * FROM hits",
    "glossary_units": f"WITH {HITS_SQL}, u AS (SELECT DISTINCT text_id, unit_id FROM hits JOIN entries USING (entry_id)) SELECT text_id, unit_id, entry_id, alias FROM u JOIN entries USING (unit_id)",
    "glossary_render": f"WITH {ENTRIES_SQL} SELECT unit_id, string_agg(alias || ' / ' || lower(alias) || ' → z' || entry_id, chr(10) ORDER BY entry_id) AS block FROM entries GROUP BY 1",
    "cost_ledger": "SELECT user_id, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM events WHERE CAST(value AS DECIMAL(18,2)) <> 0 GROUP BY ROLLUP (user_id, event_type)",
    "model_cost": """WITH u AS (SELECT l_returnflag, CAST(trunc(l_extendedprice) AS BIGINT) AS p, CAST(trunc(l_quantity) AS BIGINT) AS c, l_linenumber * 100 AS o, l_suppkey % 50 AS t FROM lineitem),
k AS (SELECT *, CASE l_returnflag WHEN 'A' THEN ((p - c) * 0.25::DOUBLE + c * 0.025::DOUBLE + (o + t) * 1.5::DOUBLE) / 1000000 WHEN 'N' THEN ((p - c) * 0.5::DOUBLE + c * 0.1::DOUBLE + (o + t) * 3::DOUBLE) / 1000000 ELSE 0 END AS cost, (c * 0.0028::DOUBLE + p * 0.14::DOUBLE + o * 0.28::DOUBLE) / 1000000 AS fix FROM u)
SELECT CASE l_returnflag WHEN 'A' THEN 'gemini-3.1-flash-lite-preview' WHEN 'N' THEN 'gemini-3-flash-preview' ELSE 'another' END AS model, CAST(sum(CAST(round_even(cost * 1e9::DOUBLE, 0) AS BIGINT)) AS BIGINT) AS nano_usd, CAST(sum(CAST(round_even(fix * 1e9::DOUBLE, 0) AS BIGINT)) AS BIGINT) AS repair_nano_usd, count(*) AS calls FROM k GROUP BY 1""",
    "asr_cost": "WITH s AS (SELECT conv_id, greatest(CASE WHEN conv_id % 3 > 0 THEN CAST(conv_id - 20 AS DOUBLE) ELSE max(length(text) / 16::DOUBLE - turn * 10) END, 0) AS seconds FROM conversations GROUP BY 1) SELECT conv_id, seconds, round(seconds / 3600 * 0.22::DOUBLE, 8) AS cost FROM s",
    "chunk_summary": """SELECT o_orderkey // 512 AS chunk, CAST(sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT)) AS BIGINT) AS cost_cents, CAST(sum(length(o_orderpriority)) AS BIGINT) AS retries, count(*) FILTER (o_orderstatus <> 'F') AS completed,
sha256(coalesce(string_agg(CASE WHEN o_orderstatus = 'F' THEN printf('%012d', o_orderkey) END, ',' ORDER BY o_orderkey), '')) AS failures FROM orders GROUP BY 1""",
    "interval_lattice": f"""WITH {INTERVALS_SQL}, r AS (SELECT event_id, CAST(k * {STEP} AS BIGINT) AS at_ms, end_ms FROM (SELECT *, unnest(range((start_ms + {STEP - 1}) // {STEP}, (end_ms - 1) // {STEP} + 1)) AS k FROM iv))
SELECT event_id, at_ms FROM r UNION SELECT event_id, end_ms FROM iv""",
    "even_timestamps": f"WITH {INTERVALS_SQL} SELECT event_id, CAST(k - 1 AS INT) AS k, CAST(end_ms - start_ms AS DOUBLE) / 4 * k AS at FROM iv, unnest([1, 2, 3]) AS t(k) WHERE end_ms > start_ms",
    "midpoint_split": SPLIT_SQL,
    "cyclic_select": "WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey, (p_partkey - 1 - (n - 3) + n) % n AS turn FROM part, n WHERE (p_partkey - 1 - (n - 3) + n) % n < 7",
    "role_fill_forward": """SELECT conv_id, turn, role AS who, nullif(head, '') AS role FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM conversations) WHERE role <> 'user'""",
    "stage_next": "WITH s AS (SELECT * FROM (VALUES (0, 'view'), (1, 'click'), (2, 'cart'), (3, 'purchase'), (4, 'error')) t(stage_ord, stage)), d AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-02 00:00:00' UNION SELECT user_id, 'cart' FROM events WHERE event_type = 'purchase' AND value < 20), o AS (SELECT user_id, stage_ord, stage FROM (SELECT DISTINCT user_id FROM events), s WHERE stage_ord <= 3 AND (user_id, stage) NOT IN (SELECT user_id, event_type FROM d)) SELECT user_id, min(stage_ord) AS stage_ord, arg_min(stage, stage_ord) AS stage FROM o GROUP BY 1",
    "sanitize_filename": r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '[^\p{L}\p{N}_\s-]', '', 'g'), '^\s+|\s+$', '', 'g'), '[-\s]+', '_', 'g') AS name FROM pages",
    "parse_source_id": SOURCE_SQL,
    "json_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "asr_words": ASR_SQL,
}
