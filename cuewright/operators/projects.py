"""Project rows and their state: lookup or creation, hints, contexts, parents' briefings, cyclic pointers, files to choose from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def looked_up(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, hint, parent, known, ignored) of requests (id, hint, parent): known projects keep their own hint and parent,
    and ignored tells that others were given; unknown ones take the request's."""
    own = projects.select("id", F.col("hint").alias("own_hint"), F.col("parent").alias("own_parent"), F.lit(True).alias("k"))
    rows = requests.join(own, "id", "left")
    known = F.col("k").isNotNull()
    pick = lambda c: F.when(known, F.col(f"own_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("id", pick("hint"), pick("parent"), known.alias("known"), (known & (F.col("hint").isNotNull() | F.col("parent").isNotNull())).alias("ignored"))


def saved(states: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The state table with the changed rows in place of those of equal key."""
    return states.join(changed.select(key), key, "left_anti").unionByName(changed)


def version_hint(hint: Column, site: Column, title: Column, description: Column) -> Column:
    """A hint that is set stays; else the title, with the description for all sites but bilibili."""
    told = F.when((site != "bilibili") & description.isNotNull(), F.concat(title, F.lit(" - "), description)).otherwise(title)
    return F.coalesce(hint, told)


#: A fixed text.
TALENT_HEADER = "Official source cast/talent metadata:"


def talent_context(talents: Column) -> Column:
    """Talents (name, name_kana, roles) as lines under a header; null without any."""

    def line(t: Column) -> Column:
        kana = F.when(F.coalesce(t["name_kana"], F.lit("")) != "", F.concat(F.lit(" / "), t["name_kana"])).otherwise("")
        roles = F.when(F.size(t["roles"]) > 0, F.concat(F.lit(" ("), F.array_join(t["roles"], ", "), F.lit(")"))).otherwise("")
        return F.concat(F.lit("- "), t["name"], kana, roles)

    return F.when(F.size(talents) > 0, F.concat(F.lit(TALENT_HEADER + "\n"), F.array_join(F.transform(talents, line), "\n")))


def document(*sections: Column) -> Column:
    """Sections that are there, apart by a line feed."""
    return F.concat_ws("\n", *sections)


BRIEFING = (
    "struct<summary:string,characters:array<struct<name_jp:string,name_zh:string,role_note:string>>,proper_nouns:map<string,string>,glossary:map<string,string>,"
    "catchphrases:array<struct<phrase_jp:string,phrase_zh:string,note:string>>,tone_notes:string,segment_summaries:array<struct<from_index:int,to_index:int,summary:string>>>"
)


def briefing(raw: Column) -> Column:
    """A briefing by its schema; anything that doesn't fit raises."""
    return F.from_json(raw, BRIEFING, {"mode": "FAILFAST"})


def parent_briefings(projects: DataFrame, briefings: DataFrame) -> DataFrame:
    """(id, briefing): the parent's briefing text, null without a parent; raises if the parent has none. briefings: (id, raw)."""
    rows = projects.select("id", "parent").join(briefings.select(F.col("id").alias("parent"), "raw"), "parent", "left")
    lacks = F.col("parent").isNotNull() & F.col("raw").isNull()
    return rows.select("id", F.when(lacks, F.raise_error(F.concat(F.lit("no briefing of the parent "), F.col("parent").cast("string")))).otherwise(F.col("raw")).alias("briefing"))


def prepared(files: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, ordinal, n) of the files named by three digits; these have to run on from 000 without a gap."""
    found = files.where(F.col(name).rlike(r"^\d{3}\.mp4$")).select(key, name)
    by_name = Window.partitionBy(key).orderBy(name)
    rows = found.select(key, name, (F.row_number().over(by_name) - 1).alias("ordinal"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    gap = F.left(name, F.lit(3)).cast("int") != F.col("ordinal")
    return rows.withColumn("ordinal", F.when(gap, F.raise_error(F.concat(F.lit("chunks don't run on from 000: "), F.col(name))).cast("int")).otherwise(F.col("ordinal")))


def cyclic_choice(items: DataFrame, states: DataFrame, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(chosen, next states): k items of each key from its pointer on, wrapping round, with turn; and the pointer behind them.

    items: (key, ordinal, n, ...); states: (key, next_index), 0 where there is none. A negative pointer and fewer than k
    items raise. The pointers are for saved() once the choice has been used.
    """
    if k <= 0:
        raise ValueError("the number to choose must be positive")
    start = F.coalesce("next_index", F.lit(0))
    wrong = F.when(start < 0, "an invalid pointer").when(F.col("n") < k, F.format_string(f"needs at least {k} chunks, found %d", "n"))
    rows = items.join(states.select(key, "next_index"), key, "left")
    rows = rows.withColumn("start", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("bigint")).otherwise(start % F.col("n")))
    chosen = rows.withColumn("turn", F.pmod(F.col("ordinal") - F.col("start"), F.col("n"))).where(F.col("turn") < k)
    after = rows.groupBy(key).agg(F.any_value((F.col("start") + k) % F.col("n")).alias("next_index"))
    return chosen.drop("next_index", "start"), after


def cover(files: DataFrame, key: str, name: str, size: str) -> DataFrame:
    """(key, source, target): the stylised cover if it isn't empty, else the poster; no row without either."""
    ranked = files.where((F.col(size) > 0) & F.col(name).isin("poster.cover.png", "poster.jpg"))
    target = F.when(F.col(name) == "poster.cover.png", "cover.png").otherwise("cover.jpg")
    return ranked.groupBy(key).agg(F.min(F.struct(F.col(name).alias("source"), target.alias("target"))).alias("m")).select(key, "m.source", "m.target")


def segments(files: DataFrame, key: str, name: str, whole: str = "video") -> DataFrame:
    """(key, names): the .mp4 files in order, but for one that is named as the whole video without its extension."""
    found = files.where(F.col(name).endswith(".mp4") & (F.col(name) != whole))
    return found.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("names"))
