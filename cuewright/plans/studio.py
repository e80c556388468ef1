"""Queries of the stages round translation: repair, glossaries, finalising, sampling, calls, projects, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import blocks, table
from ..functions import text as X
from ..functions import timecode as T
from ..operators import calls, finalize, payloads, projects, repair, samples
from ..sources import srt
from .blocks import CHUNK_CTE, B, _cleaned_sql, chunk_bounds
from .joins import ANCHOR_STEPS, problems_sql

# ---- repair: chunks of ten events, of which some lack blocks, some have foreign timecodes, some both ----


def broken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("chunk"), (F.col("event_id") % 10).cast("int").alias("pos"), "event_id", "user_id")
    code = F.format_string("%08d", "event_id")
    source = rows.select("chunk", "pos", code.alias("timecode"))
    kept = rows.where(~((F.col("chunk") % 3 == 1) & (F.col("user_id") % 4 == 0)))
    named = F.when((F.col("chunk") % 2 == 0) & (F.col("user_id") % 5 == 0), F.concat(F.lit("x"), code)).otherwise(code)
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("pos")) - 1
    return source, kept.select("chunk", place.alias("pos"), named.alias("timecode"), F.format_string("t%d", "user_id").alias("text"))


BROKEN_SQL = """ev AS (SELECT event_id // 10 AS chunk, CAST(event_id % 10 AS INT) AS pos, event_id, user_id, printf('%08d', event_id) AS code FROM events),
source AS (SELECT chunk, pos, code AS timecode FROM ev),
output AS (SELECT chunk, CAST(row_number() OVER (PARTITION BY chunk ORDER BY pos) - 1 AS INT) AS pos, CASE WHEN chunk % 2 = 0 AND user_id % 5 = 0 THEN 'x' || code ELSE code END AS timecode, 't' || user_id AS text FROM ev WHERE NOT (chunk % 3 = 1 AND user_id % 4 = 0)),
nout AS (SELECT chunk, count(*) AS m FROM output GROUP BY 1), nsrc AS (SELECT chunk, count(*) AS n FROM source GROUP BY 1)"""


def mapping(output: DataFrame) -> DataFrame:
    """Each output block to the source block of its place; every fifth chunk names one block twice."""
    to = F.when((F.col("chunk") % 5 == 0) & (F.col("pos") == 1), F.lit(0)).otherwise(F.col("pos"))
    return output.select("chunk", F.col("pos").alias("at"), F.col("pos").alias("output_pos"), to.alias("source_pos"))


def repair_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, output = broken(spark, sf_dir)
    return repair.repaired(source, output, 2, mapping(output))


REPAIR_SQL = f"""WITH {BROKEN_SQL}, {problems_sql(2)}, {ANCHOR_STEPS},
fit AS (SELECT o.chunk FROM output o LEFT JOIN source s ON o.chunk = s.chunk AND o.timecode = s.timecode GROUP BY 1 HAVING count(*) = count(DISTINCT o.timecode) AND count(*) = count(s.timecode)),
ways AS (SELECT p.chunk, CASE WHEN ok THEN 'as it is' WHEN n = m THEN 'position' WHEN p.chunk IN (SELECT chunk FROM fit) THEN 'subset'
  WHEN p.chunk IN (SELECT chunk FROM found) AND p.chunk NOT IN (SELECT chunk FROM idle) THEN 'anchors' WHEN p.chunk % 5 <> 0 OR m < 2 THEN 'mapping' END AS way FROM problems p JOIN nsrc USING (chunk) JOIN nout USING (chunk))
SELECT s.chunk, s.pos, s.timecode, CASE WHEN way IN ('as it is', 'subset') THEN coalesce(t.text, '') WHEN way = 'anchors' THEN coalesce(f.text, '') ELSE coalesce(o.text, '') END AS text, way
FROM source s JOIN ways w USING (chunk) LEFT JOIN output t ON t.chunk = s.chunk AND t.timecode = s.timecode LEFT JOIN output o ON o.chunk = s.chunk AND o.pos = s.pos LEFT JOIN found f ON f.chunk = s.chunk AND f.pos = s.pos WHERE way IS NOT NULL"""


def repair_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that no local strategy repairs, with what is wrong."""
    source, output = broken(spark, sf_dir)
    return repair.unresolved(source, output, 2, repair.repaired(source, output, 2))


FAILURES_SQL = REPAIR_SQL.rsplit("SELECT s.chunk, s.pos", 1)[0] + "SELECT chunk, errors AS error FROM problems JOIN ways USING (chunk) WHERE way = 'mapping' OR way IS NULL"


def fix_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.requests(*broken(spark, sf_dir), 2)


PROMPTS_SQL = f"""WITH {BROKEN_SQL}, {problems_sql(2)},
a AS (SELECT chunk, string_agg((pos + 1) || chr(10) || timecode || chr(10), chr(10) || chr(10) ORDER BY pos) || chr(10) AS x FROM source GROUP BY 1),
b AS (SELECT chunk, string_agg((pos + 1) || chr(10) || timecode || chr(10) || text, chr(10) || chr(10) ORDER BY pos) || chr(10) AS y FROM output GROUP BY 1)
SELECT chunk, concat_ws(chr(10) || '---' || chr(10), errors, x, coalesce(y, chr(10))) AS prompt FROM problems JOIN a USING (chunk) LEFT JOIN b USING (chunk) WHERE NOT ok"""


def merged_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of ten chunks each as one document; some lines are bare dashes."""
    _, output = broken(spark, sf_dir)
    text = F.concat(F.col("text"), F.when(F.col("pos") % 4 == 1, "\n -").otherwise(""))
    rows = output.select(F.floor(F.col("chunk") / 10).alias("project_id"), "chunk", "pos", "timecode", text.alias("text"))
    return finalize.merged(rows)


MERGED_SQL = f"""WITH {BROKEN_SQL}, o AS (SELECT chunk // 10 AS project_id, row_number() OVER (PARTITION BY chunk // 10 ORDER BY chunk, pos) AS i, timecode, text FROM output)
SELECT project_id, string_agg(i || chr(10) || timecode || chr(10) || text, chr(10) || chr(10) ORDER BY i) || chr(10) AS document FROM o GROUP BY 1"""


# ---- finalising ----------------------------------------------------------------------------------


def finalize_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of both documents of each project; a misspaced name opens every block."""
    named = blocks(spark, sf_dir).withColumn("text", F.concat(F.lit("漢TwoTribe字 "), F.col("text"), F.lit("。")))
    out = finalize.finalized(named, ["Two Tribe"])
    return out.select("project_id", F.sha2("ass", 256).alias("ass"), F.sha2("srt", 256).alias("srt"))


def _ass(ms: str) -> str:
    return f"printf('%d:%02d:%02d.%02d', {ms}//3600000, {ms}//60000%60, {ms}//1000%60, {ms}%1000//10)"


_NAMED = "'漢 Two Tribe 字 ' || text || '。'"
FINALIZE_SQL = B + f""", c AS (SELECT *, {_cleaned_sql(_NAMED)} AS t FROM blocks)
SELECT project_id, sha256('{srt.ASS_HEADER}' || string_agg('Dialogue: 0,' || {_ass('start_ms')} || ',' || {_ass('end_ms')} || ',Default,,0,0,0,,' || t, chr(10) ORDER BY pos) || chr(10)) AS ass,
sha256(string_agg(index || chr(10) || timecode || chr(10) || t, chr(10) || chr(10) ORDER BY pos) || chr(10)) AS srt FROM c GROUP BY 1"""


def suspect_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspect blocks of each project as a list; the terms are whole words of a glossary."""
    found = blocks(spark, sf_dir).where(X.is_suspect(F.col("text"), ("the", "of", "de", "la")))
    return finalize.suspect_list(found)


LISTING_SQL = B + """, s AS (SELECT * FROM blocks WHERE len(list_filter(regexp_extract_all(text, '[A-Za-zぁ-ゖァ-ヺー]+'), lambda r: NOT list_contains(['the', 'of', 'de', 'la'], r) AND regexp_matches(r, '[A-Za-z]{2,}|[ぁ-ゖァ-ヺー]{2,}'))) > 0)
SELECT project_id, string_agg('- #' || index || ': ' || trim(text), chr(10) ORDER BY pos) AS listing FROM s GROUP BY 1"""


# ---- glossaries as JSON: ten parts a document ------------------------------------------------------


def glossary_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, value): JSON in prose, talents from odd parts under a group that is sometimes bad, others from even ones."""
    part = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("text_id"), (F.col("p_partkey") % 10).alias("k"), "p_name", "p_brand", "p_size")
    target = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).when(F.col("p_size") % 4 == 1, F.concat(F.lit("漢"), F.col("p_name"))).when(F.col("p_size") % 4 == 2, F.lit("")).otherwise(F.lit("純漢"))
    entry = F.struct(F.array("p_name", "p_brand").alias("jp"), target.alias("zh"))
    listed = part.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))).alias("rows"))
    members = F.transform(F.filter("rows", lambda r: r["k"] % 2 == 1), lambda r: r["e"])
    others = F.transform(F.filter("rows", lambda r: r["k"] % 2 == 0), lambda r: r["e"])
    group = F.struct(F.array(F.concat(F.lit("G"), F.col("text_id").cast("string"))).alias("jp"), F.when(F.col("text_id") % 3 == 0, "").otherwise("組Q").alias("zh"))
    value = F.to_json(F.struct(F.array(F.struct(group.alias("group"), members.alias("members"))).alias("talents"), others.alias("others")))
    return listed.select("text_id", F.concat(F.lit("Here:\n"), value, F.lit("\nDone.")).alias("value"))


def _glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.glossary_entries(glossary_payloads(spark, sf_dir), "value", ("text_id",))


def glossary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glossary(spark, sf_dir).withColumn("aliases", F.array_join("aliases", "|"))


GLOSSARY_CTE = """WITH p AS (SELECT p_partkey // 10 AS text_id, p_partkey % 10 AS k, p_name || '|' || p_brand AS aliases, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN '漢' || p_name WHEN 2 THEN '' ELSE '純漢' END AS target FROM part),
m AS (SELECT text_id, k, aliases, target FROM p WHERE k % 2 = 1 AND target <> ''),
t AS (SELECT text_id, -1 AS k, true AS is_group, 'G' || text_id AS aliases, '組Q' AS target FROM (SELECT DISTINCT text_id FROM m) WHERE text_id % 3 <> 0 UNION ALL SELECT text_id, k, false, aliases, target FROM m),
g AS (SELECT text_id, 'talent' AS kind, 0 AS unit_id, CAST(row_number() OVER (PARTITION BY text_id ORDER BY k) - 1 AS INT) AS entry_pos, is_group, aliases, target FROM t
  UNION ALL SELECT text_id, 'other', NULL, CAST(row_number() OVER (PARTITION BY text_id ORDER BY k) - 1 AS INT), false, aliases, target FROM p WHERE k % 2 = 0 AND target <> '')"""


def curated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalize.curated_names(_glossary(spark, sf_dir))


def foreign_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspect targets with their rank, the longest first."""
    terms = finalize.foreign_terms(_glossary(spark, sf_dir))
    return terms.select("term", F.row_number().over(Window.orderBy(F.length("term").desc(), "term")).alias("nth"))


def glossary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _glossary(spark, sf_dir).withColumn("unit_id", F.when(F.col("kind") == "talent", F.col("text_id")))
    return finalize.entry_counts(rows)


def glossary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole glossary for even documents, the filtered one for odd ones."""
    entries = _glossary(spark, sf_dir)
    return finalize.glossary_block(entries.where("text_id % 2 = 0"), True).unionByName(finalize.glossary_block(entries.where("text_id % 2 = 1"), False))


PROMPT_SQL = GLOSSARY_CTE + f""", l AS (SELECT *, replace(aliases, '|', ' / ') || ' → ' || target AS line FROM g),
u AS (SELECT text_id, '{finalize.TALENTS}' || chr(10) || CASE WHEN bool_or(is_group) THEN '' ELSE '{finalize.ALONE}' || chr(10) END || string_agg(CASE WHEN is_group THEN '{finalize.GROUP}' ELSE '    · ' END || line, chr(10) ORDER BY entry_pos) AS a FROM l WHERE kind = 'talent' GROUP BY 1),
o AS (SELECT text_id, '{finalize.OTHERS}' || chr(10) || string_agg('- ' || line, chr(10) ORDER BY entry_pos) AS b FROM l WHERE kind = 'other' GROUP BY 1)
SELECT text_id, CASE WHEN text_id % 2 = 0 THEN '{finalize.FULL_HEADER}' ELSE '{finalize.FILTERED_HEADER}' END || concat_ws(chr(10), a, b) AS block FROM u FULL JOIN o USING (text_id)"""


# ---- sampling ------------------------------------------------------------------------------------

STEP, INTRO = 7000, 9000


def chunk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.chunk_samples(chunk_bounds(spark, sf_dir), ["project_id"], STEP, INTRO)


FRAMES_CTE = CHUNK_CTE + f""", b AS (SELECT project_id, chunk, min(index) AS from_index, max(index) AS to_index, min(start_ms) AS a, max(end_ms) AS z FROM chunks GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN chunk = 0 THEN least(greatest(a, {INTRO}), z) ELSE a END AS s FROM b),
f AS (SELECT project_id, chunk, CAST(k * {STEP} AS BIGINT) AS at_ms FROM (SELECT *, unnest(range((s + {STEP - 1}) // {STEP}, (z - 1) // {STEP} + 1)) AS k FROM w) UNION SELECT project_id, chunk, s FROM w UNION SELECT project_id, chunk, z FROM w)"""


def chunk_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's manifest with its sampling times and the name of its sound."""
    chunks = chunk_bounds(spark, sf_dir)
    frames = samples.chunk_samples(chunks, ["project_id"], STEP, INTRO).groupBy("project_id", "chunk").agg(F.array_sort(F.collect_list("at_ms")).alias("frames"))
    total = chunks.groupBy("project_id").agg(F.count("*").alias("total"))
    rows = chunks.join(frames, ["project_id", "chunk"]).join(total, "project_id")
    first, last, start, end = (F.col(c) for c in ("from_index", "to_index", "start_ms", "end_ms"))
    name = samples.segment_name(F.format_string("v%d", "project_id"), first, last, start, end, 7, 512)
    made = samples.manifest(F.col("chunk"), F.col("total"), first, last, start, end, name, F.col("frames"))
    return rows.select("project_id", "chunk", samples.duration(start, end).alias("duration_ms"), made.alias("manifest"))


def _seconds(ms: str) -> str:
    return f"printf('%d.%03d', {ms} // 1000, {ms} % 1000)"


MANIFESTS_SQL = FRAMES_CTE + f""", n AS (SELECT project_id, count(*) AS total FROM b GROUP BY 1), l AS (SELECT project_id, chunk, string_agg(at_ms, ',' ORDER BY at_ms) AS frames FROM f GROUP BY 1, 2),
d AS (SELECT *, printf('%04d-%04d', from_index, to_index) AS slug FROM b JOIN n USING (project_id) JOIN l USING (project_id, chunk))
SELECT project_id, chunk, z - a AS duration_ms, '{{"chunk_index":' || chunk || ',"total_chunks":' || total || ',"from_index":' || from_index || ',"to_index":' || to_index || ',"time_range":{{"start_ms":' || a || ',"end_ms":' || z || '}},"audio":"chunk_' || slug || '_'
  || left(sha256('v' || project_id || ':' || slug || ':' || {_seconds('a')} || ':' || {_seconds('z')} || ':7:512'), 10) || '.opus","frames_ms":[' || frames || ']}}' AS manifest FROM d"""


def whole_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling window of each project as a whole."""
    length = chunk_bounds(spark, sf_dir).groupBy("project_id").agg(F.max("end_ms").alias("length"))
    start, end = samples.whole_window(F.col("length"), INTRO)
    return length.select("project_id", start.alias("from_ms"), end.alias("to_ms"))


def encoder_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as progress lines of a job a user; some go back, some say something else."""
    value = F.format_string("%d", (F.floor(F.col("value") * 1000) * 1000))
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("speed="), value)).when(F.col("event_id") % 2 == 0, F.concat(F.lit("out_time_us="), value)).otherwise(F.concat(F.lit(" out_time_ms="), value))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"), F.lit(400_000).cast("bigint").alias("length"))
    return samples.progress_steps(rows, "user_id", "event_id", "line", "length")


PROGRESS_SQL = """WITH p AS (SELECT user_id, event_id, least(CAST(floor(value * 1000) AS BIGINT), 400000) AS now FROM events WHERE event_id % 7 <> 0)
SELECT user_id, event_id, CAST(greatest(now - coalesce(lag(now) OVER (PARTITION BY user_id ORDER BY event_id), 0), 0) AS BIGINT) AS step_ms FROM p"""


# ---- calls ---------------------------------------------------------------------------------------


def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests said in envelopes, on the documented path, elsewhere or not at all, some in prose."""
    k = F.col("event_id").cast("string")
    stated = F.concat(F.lit('{"stats":{"models":{"a":{"api":{"totalRequests":'), k, F.lit('}},"b":{"api":{"totalRequests":2}},"c":{"api":{"totalRequests":"x"}},"d":{}}},"totalRequests":99}'))
    nested = F.concat(F.lit('{"x":[{"totalRequests": '), k, F.lit('},{"y":{"totalRequests":3}},{"totalRequests":"no"}]}'))
    said = F.when(F.col("event_id") % 3 == 0, stated).when(F.col("event_id") % 3 == 1, nested).otherwise(F.lit('{"response":"ok"}'))
    noisy = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Update available!\n"), said, F.lit("\nbye"))).otherwise(said)
    rows = table(spark, sf_dir, "events").select("event_id", calls.envelope(noisy).alias("envelope"))
    return rows.select("event_id", calls.request_count(F.col("envelope")).alias("requests"))


def quota_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 11 == 0, 429).when(F.col("event_id") % 2 == 0, 500)
    message = F.element_at(F.array(*map(F.lit, ("fine", "Daily QUOTA used", "Rate Limit hit", "RESOURCE_EXHAUSTED", "timeout"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", code.alias("code"), message.alias("message"))
    log = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("event_id") % 30 + 1).cast("int")), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
    return rows.select("event_id", calls.is_quota_error(F.col("code"), F.col("message")).alias("quota"), calls.tail_lines(log, 20).alias("tail"))


QUOTA_SQL = """SELECT event_id, event_id % 11 = 0 OR event_id % 5 IN (1, 2, 3) AS quota,
array_to_string(list_transform(range(greatest(event_id % 30 - 18, 1), event_id % 30 + 2), lambda i: 'line ' || i), chr(10)) AS tail FROM events"""


# ---- projects --------------------------------------------------------------------------------------


def project_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests; those of three nations are known projects. Hints by site, title and description."""
    rows = table(spark, sf_dir, "customer")
    asked = rows.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("hint"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey")).alias("parent"))
    known = rows.where("c_nationkey < 3").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("hint"), F.lit(None).cast("int").alias("parent"))
    found = projects.looked_up(asked, known)
    site = F.when(F.col("id") % 3 == 0, "bilibili").otherwise("tver")
    told = projects.version_hint(F.col("hint"), site, F.format_string("T%d", "id"), F.when(F.col("id") % 7 != 0, F.format_string("D%d", "id")))
    return found.select("id", "parent", "known", "ignored", told.alias("hint"))


LOOKUP_SQL = """SELECT c_custkey AS id, CASE WHEN c_nationkey >= 3 AND c_custkey % 5 = 0 THEN c_nationkey END AS parent, c_nationkey < 3 AS known, c_nationkey < 3 AND (c_custkey % 2 = 0 OR c_custkey % 5 = 0) AS ignored,
coalesce(CASE WHEN c_nationkey < 3 THEN CASE WHEN c_acctbal > 0 THEN c_mktsegment END WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN 'T' || c_custkey || ' - D' || c_custkey ELSE 'T' || c_custkey END) AS hint FROM customer"""


def saved_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' states with those in debt replaced."""
    states = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("state"))
    changed = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_suppkey", F.concat(F.lit("paid "), F.col("s_name")).alias("state"))
    return projects.saved(states, changed, "s_suppkey")


def talent_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as talents of their nation: some without a name, some without kana or genres."""
    talent = F.struct(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("カナ"), F.col("c_custkey").cast("string"))).alias("name_kana"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("genre1"),
        F.lit("").alias("genre2"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("MC")).alias("genre3"),
    )
    group = F.floor(F.col("c_custkey") / 20).alias("episode")
    listed = table(spark, sf_dir, "customer").groupBy(group).agg(F.array_sort(F.collect_list(F.struct("c_custkey", talent.alias("t")))).alias("l"))
    return listed.select("episode", F.to_json(F.struct(F.transform("l", lambda r: r["t"]).alias("talents"))).alias("payload"))


def source_talents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads.talent_rows(talent_payloads(spark, sf_dir), "payload", ("episode",))
    return rows.withColumn("roles", F.array_join("roles", "|"))


TALENTS_CTE = """WITH t AS (SELECT c_custkey // 20 AS episode, c_custkey, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'カナ' || c_custkey END AS name_kana,
concat_ws('|', CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, CASE WHEN c_custkey % 4 = 0 THEN 'MC' END) AS roles FROM customer WHERE c_custkey % 9 <> 0)"""


def talent_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads.talent_rows(talent_payloads(spark, sf_dir), "payload", ("episode",))
    listed = rows.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("n"), F.struct("name", "name_kana", "roles").alias("t")))).alias("l"))
    context = projects.talent_context(F.transform("l", lambda r: r["t"]))
    return listed.select("episode", projects.document(F.lit("Episode"), context, F.lit(None).cast("string"), F.lit("---")).alias("prompt"))


CONTEXT_SQL = TALENTS_CTE + f""" SELECT episode, 'Episode' || chr(10) || '{projects.TALENT_HEADER}' || chr(10) || string_agg('- ' || name || coalesce(' / ' || name_kana, '') || CASE WHEN roles = '' THEN '' ELSE ' (' || replace(roles, '|', ', ') || ')' END, chr(10) ORDER BY c_custkey) || chr(10) || '---' AS prompt FROM t GROUP BY 1"""


def parent_briefings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as projects whose parent is the nation of their region's number; parents have briefings with names."""
    nation = table(spark, sf_dir, "nation")
    rows = nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") > 4, F.col("n_regionkey")).alias("parent"))
    names = F.struct(F.map_from_arrays(F.array(F.col("n_name")), F.array(F.concat(F.lit("P"), F.col("n_name")))).alias("proper_nouns"), F.array(F.struct(F.concat(F.lit("C"), F.col("n_name")).alias("name_zh"))).alias("characters"))
    raw = nation.select(F.col("n_nationkey").alias("id"), F.to_json(names).alias("raw"))
    found = projects.parent_briefings(rows, raw)
    checked = found.withColumn("briefing", F.when(projects.briefing(F.col("briefing")).isNotNull(), F.col("briefing")))
    return payloads.name_targets(checked, "briefing", ("id",))


BRIEFINGS_SQL = """WITH j AS (SELECT n.n_nationkey AS id, p.n_name AS name FROM nation n JOIN nation p ON p.n_nationkey = n.n_regionkey WHERE n.n_nationkey > 4)
SELECT id, 'P' || name AS unit FROM j UNION ALL SELECT id, 'C' || name FROM j"""


def cyclic_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of ten prepared chunks of each part group from its pointer on, and the pointer behind them."""
    part = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("noise"), F.format_string("%03d.mp4", F.col("p_partkey") % 10).alias("name"))
    states = part.where("noise % 3 > 0").select("noise", (F.col("noise") * 7 % 40).alias("next_index")).distinct()
    chosen, after = projects.cyclic_choice(projects.prepared(part, "noise", "name"), states, "noise", 5)
    return chosen.join(projects.saved(states, after, "noise"), "noise").select("noise", "name", "turn", "next_index")


CYCLIC_SQL = """WITH p AS (SELECT p_partkey // 10 AS noise, p_partkey % 10 AS o, CASE WHEN p_partkey // 10 % 3 > 0 THEN p_partkey // 10 * 7 % 40 % 10 ELSE 0 END AS s FROM part)
SELECT noise, printf('%03d.mp4', o) AS name, (o - s + 10) % 10 AS turn, (s + 5) % 10 AS next_index FROM p WHERE (o - s + 10) % 10 < 5"""


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of a project each four: its cover and its video segments."""
    kind = F.element_at(F.array(*map(F.lit, ("poster.cover.png", "poster.jpg", "b.mp4", "a.mp4"))), (F.col("page_id") % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 4).alias("project"), kind.alias("name"), F.when(F.col("page_id") % 3 == 0, 0).otherwise(F.length("html")).alias("size"))
    return files.select("project").distinct().join(projects.cover(files, "project", "name", "size"), "project", "left").join(projects.segments(files, "project", "name"), "project", "left")


FILES_SQL = """WITH f AS (SELECT page_id // 4 AS project, page_id % 4 AS k, page_id % 3 <> 0 AND length(html) > 0 AS solid FROM pages), g AS (SELECT project, bool_or(k = 0 AND solid) AS c, bool_or(k = 1 AND solid) AS p, bool_or(k = 2) AS b, bool_or(k = 3) AS a FROM f GROUP BY 1)
SELECT project, CASE WHEN c THEN 'poster.cover.png' WHEN p THEN 'poster.jpg' END AS source, CASE WHEN c THEN 'cover.png' WHEN p THEN 'cover.jpg' END AS target, nullif(concat_ws(',', CASE WHEN a THEN 'a.mp4' END, CASE WHEN b THEN 'b.mp4' END), '') AS names FROM g"""


# ---- documents -------------------------------------------------------------------------------------


def lenient_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in broken documents: a wrong number, no timecode, a loosely padded one."""
    loose = F.format_string("0:0:%d,5 --> 0:0:%d,75", F.col("pos") % 10, F.col("pos") % 10)
    head = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("number?\n"), F.col("timecode"), F.lit("\n"))).when(F.col("pos") % 3 == 1, F.lit("7\n")).otherwise(F.concat(loose, F.lit("\n")))
    piece = F.concat(head, F.lit("t "), F.col("text"), F.lit("."))
    listed = F.array_sort(F.collect_list(F.struct("pos", piece.alias("p"))))
    documents = blocks(spark, sf_dir).groupBy("project_id").agg(F.concat(F.lit("﻿"), F.array_join(F.transform(listed, lambda r: r["p"]), "\r\n\r\n")).alias("document"))
    return srt.parse_lenient(documents, first=5)


LENIENT_SQL = B + f""" SELECT project_id, CAST(pos + 5 AS INT) AS index, CASE pos % 3 WHEN 0 THEN timecode WHEN 1 THEN '{srt.ZERO}' ELSE printf('0:0:%d,5 --> 0:0:%d,75', pos % 10, pos % 10) END AS timecode,
CASE pos % 3 WHEN 1 THEN '7' || chr(10) ELSE '' END || 't ' || text || '.' AS text FROM blocks"""


def srt_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of documents whose blocks stand in reverse order, by start."""
    reverse = blocks(spark, sf_dir).withColumn("pos", -F.col("pos"))
    return srt.ranges(srt.serialize(reverse)).select("project_id", "nth", "start_ms", "end_ms")


def timecode_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict and lenient checks of timecodes in several spellings, and durations clamped at zero."""
    code = F.when(F.col("pos") % 4 == 0, F.col("timecode")).when(F.col("pos") % 4 == 1, F.replace("timecode", F.lit(","), F.lit("."))).when(F.col("pos") % 4 == 2, F.format_string("0:%d:1,5-->1:2:3.25", F.col("pos") % 60)).otherwise(F.concat(F.col("timecode"), F.lit(" x")))
    rows = blocks(spark, sf_dir).withColumn("code", code)
    length = samples.duration(F.col("start_ms"), F.col("end_ms") - F.col("pos") % 3 * 1000)
    return rows.select("project_id", "pos", T.is_timecode(F.col("code")).alias("strict"), T.is_timecode(F.col("code"), True).alias("lenient"), length.alias("length_ms"))


def cast_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as credit lists: users' turns are headings, a system's clears them."""
    line = F.when(F.col("role") == "system", "■").when(F.col("role") == "user", F.concat(F.lit("■ "), F.col("text"))).otherwise(F.col("text"))
    listed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("ls"))
    raw = listed.select("conv_id", F.to_json(F.struct(F.transform("ls", lambda r: r["l"]).alias("casts"))).alias("payload"))
    return payloads.cast_rows(raw, "conv_id", "payload")


CASTS_SQL = """WITH h AS (SELECT *, last_value(CASE role WHEN 'system' THEN '' WHEN 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM conversations)
SELECT conv_id, CAST(row_number() OVER w AS INT) AS nth, 'abema:' || conv_id || ':' || row_number() OVER w AS id, text AS name, nullif(head, '') AS role FROM h WHERE role NOT IN ('system', 'user') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""

_FUNCTIONS = (
    repair_chain, repair_failures, fix_prompts, merged_translation, finalize_export, suspect_listing, glossary_json, curated_names, foreign_terms, glossary_counts, glossary_prompt,
    chunk_frames, chunk_manifests, whole_windows, encoder_progress, request_counts, quota_errors, project_lookup, saved_states, source_talents, talent_contexts, parent_briefings,
    cyclic_state, package_files, lenient_blocks, srt_ranges, timecode_checks, cast_lists,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
ORACLE = {
    "repair_chain": REPAIR_SQL,
    "repair_failures": FAILURES_SQL,
    "fix_prompts": PROMPTS_SQL,
    "merged_translation": MERGED_SQL,
    "finalize_export": FINALIZE_SQL,
    "suspect_listing": LISTING_SQL,
    "glossary_json": GLOSSARY_CTE + " SELECT * FROM g",
    "curated_names": GLOSSARY_CTE + " SELECT DISTINCT target AS unit FROM g WHERE regexp_matches(target, '[A-Za-z]') AND regexp_matches(target, '[ぁ-ゖァ-ヺ一-鿿]')",
    "foreign_terms": GLOSSARY_CTE + ", w AS (SELECT DISTINCT target AS term FROM g WHERE regexp_matches(target, '[A-Za-z]{2,}|[ぁ-ゖァ-ヺー]{2,}')) SELECT term, CAST(row_number() OVER (ORDER BY length(term) DESC, term) AS INT) AS nth FROM w",
    "glossary_counts": GLOSSARY_CTE + " SELECT kind, count(DISTINCT CASE WHEN kind = 'talent' THEN text_id END) AS units, count(*) AS entries FROM g GROUP BY 1",
    "glossary_prompt": PROMPT_SQL,
    "chunk_frames": FRAMES_CTE + " SELECT * FROM f",
    "chunk_manifests": MANIFESTS_SQL,
    "whole_windows": B + f" SELECT project_id, least({INTRO}, greatest(max(end_ms) - 1500, 0)) AS from_ms, greatest(max(end_ms) - 1500, 0) AS to_ms FROM blocks GROUP BY 1",
    "encoder_progress": PROGRESS_SQL,
    "request_counts": "SELECT event_id, greatest(CASE event_id % 3 WHEN 0 THEN event_id + 2 WHEN 1 THEN event_id + 3 ELSE 1 END, 1) AS requests FROM events",
    "quota_errors": QUOTA_SQL,
    "project_lookup": LOOKUP_SQL,
    "saved_states": "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'paid ' || s_name ELSE s_name END AS state FROM supplier",
    "source_talents": TALENTS_CTE + " SELECT episode, id, name, name_kana, roles FROM t",
    "talent_contexts": CONTEXT_SQL,
    "parent_briefings": BRIEFINGS_SQL,
    "cyclic_state": CYCLIC_SQL,
    "package_files": FILES_SQL,
    "lenient_blocks": LENIENT_SQL,
    "srt_ranges": B + " SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY start_ms, pos DESC) AS INT) AS nth, start_ms, end_ms FROM blocks",
    "timecode_checks": B + " SELECT project_id, pos, pos % 4 < 2 AS strict, pos % 4 < 3 AS lenient, CAST(greatest(1500 - pos % 3 * 1000, 0) AS BIGINT) AS length_ms FROM blocks",
    "cast_lists": CASTS_SQL,
}
