"""Nested payloads as rows: transcribed words, talents and casts, glossaries, mapping responses, noisy JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE, json_object, stripped

WORD = "struct<text:string,start:double,end:double,type:string,speaker_id:string>"
ASR = f"struct<audio_duration_secs:double,words:array<{WORD}>,transcripts:array<struct<words:array<{WORD}>>>>"
MAPPING = "struct<jp:array<string>,zh:string>"
GLOSSARY = f"struct<talents:array<struct<group:{MAPPING},members:array<{MAPPING}>>>,others:array<{MAPPING}>>"
HARD = "。！？?!"


def word_items(payload: Column) -> Column:
    """The top-level words, else those of all transcripts, else none."""
    asr = F.from_json(payload, ASR)
    nested = F.flatten(F.transform(asr["transcripts"], lambda t: F.coalesce(t["words"], F.array().cast(f"array<{WORD}>"))))
    return F.coalesce(asr["words"], nested, F.array().cast(f"array<{WORD}>"))


def usable_words(payloads: DataFrame, key: str, payload: str, ignored: tuple[str, ...] = ("audio_event",)) -> DataFrame:
    """(key, tok_pos, text, start, end, speaker_id) in time order.

    Ignored kinds, empty texts, missing or inverted bounds go; a leading hard mark becomes a word of no length.
    """
    items = payloads.select(key, F.posexplode(word_items(F.col(payload))).alias("at", "w")).select(key, "at", "w.*")
    kept = items.where(~F.coalesce(F.col("type").isin(*ignored), F.lit(False)) & (F.col("text") != "") & (F.col("end") >= F.col("start")))
    whole = F.struct("text", "start", "end")
    mark = F.struct(F.substring("text", 1, 1).alias("text"), "start", F.col("start").alias("end"))
    rest = F.struct(F.expr("substring(text, 2)").alias("text"), "start", "end")
    opens = (F.length("text") > 1) & F.substring("text", 1, 1).isin(*HARD)
    parts = kept.select(key, "at", "speaker_id", F.posexplode(F.when(opens, F.array(mark, rest)).otherwise(F.array(whole))).alias("sub", "p"))
    order = Window.partitionBy(key).orderBy("p.start", "p.end", "at", "sub")
    return parts.select(key, (F.row_number().over(order) - 1).alias("tok_pos"), "p.text", "p.start", "p.end", "speaker_id")


def glossary_entries(raw: DataFrame, payload: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, kind, unit_id, entry_pos, is_group, aliases, target) from glossary JSON.

    An entry needs aliases without an empty one and a target; a unit needs a valid member; a bad group
    leaves its members as they are. Text that isn't such JSON gives no rows.
    """
    parsed = raw.select(*keys, F.from_json(json_object(F.col(payload)), GLOSSARY).alias("g"))

    def valid(e: Column) -> Column:
        return e.isNotNull() & (F.size(e["jp"]) > 0) & F.forall(e["jp"], lambda a: a.isNotNull() & (a != "")) & (F.coalesce(e["zh"], F.lit("")) != "")

    units = parsed.select(*keys, F.posexplode("g.talents").alias("unit_id", "u"))
    members = F.filter("u.members", valid)
    group = F.when(F.coalesce(valid(F.col("u.group")), F.lit(False)), F.array(F.struct(F.lit(True).alias("is_group"), F.col("u.group").alias("e"))))
    plain = F.transform(members, lambda m: F.struct(F.lit(False).alias("is_group"), m.alias("e")))
    listed = F.concat(F.coalesce(group, F.array().cast(f"array<struct<is_group:boolean,e:{MAPPING}>>")), plain)
    talents = units.where(F.size(members) > 0).select(*keys, F.lit("talent").alias("kind"), "unit_id", F.posexplode(listed).alias("entry_pos", "x"))
    talents = talents.select(*keys, "kind", "unit_id", "entry_pos", "x.is_group", F.col("x.e.jp").alias("aliases"), F.col("x.e.zh").alias("target"))
    others = parsed.select(*keys, F.posexplode(F.filter("g.others", valid)).alias("entry_pos", "e"))
    others = others.select(*keys, F.lit("other").alias("kind"), F.lit(None).cast("int").alias("unit_id"), "entry_pos", F.lit(False).alias("is_group"), F.col("e.jp").alias("aliases"), F.col("e.zh").alias("target"))
    return talents.unionByName(others)


def talent_rows(raw: DataFrame, payload: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, name, name_kana, roles) of a talents response; items that lack an id or a name are skipped."""
    shape = "struct<talents:array<struct<id:string,name:string,name_kana:string,genre1:string,genre2:string,genre3:string>>>"
    rows = raw.select(*keys, F.explode(F.from_json(F.col(payload), shape)["talents"]).alias("t")).select(*keys, "t.*").where("id IS NOT NULL AND name IS NOT NULL")
    roles = F.filter(F.array("genre1", "genre2", "genre3"), lambda g: g.isNotNull() & (g != ""))
    return rows.select(*keys, "id", "name", "name_kana", roles.alias("roles"))


def with_heading(rows: DataFrame, key: list[str], order: list[str], is_heading: Column, heading: Column) -> DataFrame:
    """Non-heading rows with role: the last heading's before them (null before any; a blank one clears it)."""
    so_far = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("at_heading", is_heading).withColumn("part", F.sum(F.col("at_heading").cast("int")).over(so_far))
    part = Window.partitionBy(*key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    role = F.when(F.col("part") > 0, F.nullif(F.first(heading).over(part), F.lit("")))
    return marked.withColumn("role", role).where(~F.col("at_heading")).drop("at_heading", "part")


def cast_rows(raw: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, nth, id, name, role) of a credit list whose lines that start with ■ give the role of what follows; a bare one clears it.

    The id is abema:key:nth, nth counting the names from 1.
    """
    lines = raw.select(key, F.posexplode(F.from_json(F.col(payload), "struct<casts:array<string>>")["casts"]).alias("at", "line"))
    lines = lines.withColumn("line", stripped(F.col("line"))).where("line <> ''")
    head = F.col("line").startswith("■")
    named = with_heading(lines, [key], ["at"], head, F.regexp_replace("line", f"^■[{WHITE}]*", ""))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return named.select(key, nth.alias("nth"), F.concat_ws(":", F.lit("abema"), F.col(key).cast("string"), nth.cast("string")).alias("id"), F.col("line").alias("name"), "role")


ASSIGNMENTS = "struct<assignments:array<struct<output_index:int,source_index:int>>>"


def mapping_error(payload: Column) -> Column:
    """What is wrong with a mapping response as text, null if nothing is."""
    said = F.from_json(json_object(payload), ASSIGNMENTS)["assignments"]
    lacks = F.exists(said, lambda a: a.isNull() | a["output_index"].isNull() | a["source_index"].isNull())
    return F.when(said.isNull(), "Fix response must contain an assignments array").when(lacks, "Each assignment must include output_index and source_index")


def mapping_rows(raw: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, at, output_index, source_index) of a mapping response; one with a mapping_error raises."""
    said = F.from_json(json_object(F.col(payload)), ASSIGNMENTS)["assignments"]
    error = mapping_error(F.col(payload))
    checked = F.when(error.isNull(), said).otherwise(F.raise_error(error))
    return raw.select(key, F.posexplode(checked).alias("at", "a")).select(key, "at", "a.*")


def name_targets(raw: DataFrame, payload: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, unit): the distinct renderings agreed in a briefing; text that is no such JSON gives none."""
    shape = "struct<proper_nouns:map<string,string>,characters:array<struct<name_zh:string>>,glossary:map<string,string>>"
    b = F.from_json(F.col(payload), shape)
    none = F.array().cast("array<string>")
    found = F.concat(F.coalesce(F.map_values(b["proper_nouns"]), none), F.coalesce(F.transform(b["characters"], lambda c: c["name_zh"]), none), F.coalesce(F.map_values(b["glossary"]), none))
    return raw.select(*keys, F.explode(found).alias("unit")).where("unit IS NOT NULL").distinct()
