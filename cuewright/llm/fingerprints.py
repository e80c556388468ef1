"""I-Match document fingerprints. DataFrame and SQL functions only.

Terms are runs of letters and digits, lower-cased. The lexicon keeps those whose inverse document
frequency ln(N / df) lies in a band. A document's distinct lexicon terms, sorted, are hashed whole
and cut down to randomised sub-lexicons of falling density; each hash is one part of the
fingerprint. Terms stand as 64-bit hashes, and sorting is by them.

The band's upper end bounds the lexicon: a term in at least N·e^-HIGH documents is one of at most
e^HIGH times the mean number of distinct terms of a document, however many documents there are. Up to
CONSTANT terms it is a constant of the plan; a larger one, which very long documents make, is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, order_buckets, read, splits, written

#: The band of ln(N / df).
LOW, HIGH = 1.6, 6.9
#: Of each sub-lexicon: -log2 of the share of terms it keeps; each reads bits of its own of a term's hash.
SUBSETS = (0, 2, 2, 2, 4, 4, 4, 4, 4, 4, 5, 5, 5, 5, 5, 5)
BUCKETS = 1 << 16
#: Terms of a lexicon that may pass the driver, some 20 bytes each.
CONSTANT = 1_000_000
SPLIT = r"[\x00-/:-@\[-`{-\x7F]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda t: t != "")
    return F.transform(F.array_distinct(found), lambda t: F.xxhash64(t))


def lexicon(texts: DataFrame, column: str, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(h): the terms of the band, by document counts over all rows."""
    spread = texts.select(F.explode(terms(F.col(column))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    n = texts.count()
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    return spread.where((idf >= low) & (idf <= high)).select("h")


def lookup(spark: SparkSession, words: DataFrame) -> Column:
    """The lexicon as a constant array of BUCKETS arrays, each with the hashes that fall in it.

    It passes the driver as one JSON string, of a size that the band bounds; Catalyst folds the
    parsing, so tasks get the finished array and find a hash in one step.
    """
    hung = words.groupBy(F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.collect_list("h").alias("hs"))
    every = spark.range(BUCKETS).withColumnRenamed("id", "b").join(hung, "b", "left")
    listed = F.array_sort(F.collect_list(F.struct("b", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs"))))
    spelled_out = every.agg(F.to_json(F.transform(listed, lambda r: r["hs"])).alias("json")).first()["json"]
    return F.from_json(F.lit(spelled_out), "array<array<bigint>>")


def fingerprint(found: Column, known: Column) -> Column:
    """The parts as an array of hashes, null where no term falls into the sub-lexicon.

    found: hashes of distinct terms; known: those of the lexicon. A text without a lexicon term is hashed by all its terms.
    """
    def parts(terms_: Column) -> Column:
        out, bit = [], 4  # the lowest bits choose the bucket
        for j, bits in enumerate(SUBSETS):
            out.append((j, F.filter(terms_, _without(((1 << bits) - 1) << bit)) if bits else terms_))
            bit += bits
        return F.array(*[F.when(F.size(p) > 0, F.xxhash64(F.lit(j), p)) for j, p in out])

    return bound(F.array_sort(F.when(F.size(known) > 0, known).otherwise(found)), parts)


def with_fingerprint(rows: DataFrame, text: str, out: str, words: DataFrame, table: Column | None) -> DataFrame:
    """Adds the fingerprint of the text column: terms are looked up in the constant table, or joined with the lexicon."""
    if table is not None:
        in_table = lambda h: F.array_contains(F.get(table, F.pmod(h, F.lit(BUCKETS)).cast("int")), h)
        return rows.withColumn(out, bound(terms(F.col(text)), lambda f: fingerprint(f, F.filter(f, in_table))))
    numbered = written(rows.withColumn("row number", F.monotonically_increasing_id()), "numbered")  # fixed by the table
    listed = numbered.select("row number", F.explode(terms(F.col(text))).alias("h")).join(words.withColumn("known", F.lit(True)), "h", "left")
    both = listed.groupBy("row number").agg(F.collect_list("h").alias("f"), F.collect_list(F.when(F.col("known"), F.col("h"))).alias("k"))
    none = F.array().cast("array<bigint>")
    parts = fingerprint(F.coalesce("f", none), F.coalesce("k", none))
    return numbered.join(both, "row number", "left").withColumn(out, parts).drop("row number", "f", "k")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once: transform over an array of one binds it."""
    return F.get(F.transform(F.array(value), use), 0)


def _without(mask: int):
    """A predicate: no bit of the mask is set."""
    signed = mask - (1 << 64) if mask >> 63 else mask
    return lambda h: h.bitwiseAND(F.lit(signed)) == 0


def spelled(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of the parts that agree, of those which either has; 1 if neither has any."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), None).otherwise(F.coalesce(x == y, F.lit(False)).cast("int")))
    counted = F.filter(both, lambda x: x.isNotNull())
    same = F.size(F.filter(counted, lambda x: x == 1))
    return F.when(F.size(counted) == 0, F.lit(1.0)).otherwise(same / F.size(counted))


def with_next(rows: DataFrame, key: str, text: str, carried: list[str]) -> DataFrame:
    """Adds next_<c> of each carried column, from the next row by (key, text); after the last, the first.

    Rows are dealt to runs of keys cut at keys that occur, so that the first row of each run is known
    by its key and also goes, as a guest, to the end of the run before; nulls come first.
    """
    cuts = splits(rows, key, order_buckets(rows.sparkSession))
    least = rows.agg(F.min(key).alias("k"), F.count_if(F.col(key).isNull()).alias("n")).first()
    first = F.lit(None if least["n"] else least["k"]).cast(dict(rows.dtypes)[key])
    bucket = bucket_of(F.col(key), cuts)
    place = lambda b, guest: F.struct(b.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    nowhere = F.array().cast("array<struct<bucket:int,guest:boolean>>")
    places = F.concat(
        F.array(place(bucket, False)),
        F.when(F.col(key).isin(cuts), F.array(place(bucket - 1, True))).otherwise(nowhere) if cuts else nowhere,
        F.when(F.col(key).eqNullSafe(first), F.array(place(F.lit(len(cuts)), True))).otherwise(nowhere),
    )
    dealt = rows.select("*", F.explode(places).alias("place")).select(*rows.columns, "place.bucket", "place.guest")
    order = Window.partitionBy("bucket").orderBy("guest", key, text)
    led = dealt.select(*rows.columns, "guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return led.where(~F.col("guest")).drop("guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH, constant: int = CONSTANT) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last quarter replaced by the start of the next text, by ascending (id,
    text). Null texts are empty; repeated rows each count and are each other's next; other columns
    are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    words = written(lexicon(texts, "t", low, high), "lexicon")
    table = lookup(spark, words) if words.count() <= constant else None
    own = with_fingerprint(texts, "t", "p", words, table)
    led = with_next(own, "id", "t", ["t", "p"])
    n = F.char_length("t")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("t").substr(F.lit(1), n - quarter), F.col("next_t").substr(F.lit(1), quarter))
    rows = led.select("id", n.cast("bigint").alias("n_chars"), "p", "next_p", edited.alias("e"))
    rows = with_fingerprint(rows, "e", "q", words, table)
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"),
        spelled(F.col("p")).alias("fingerprint"),
        spelled(F.col("q")).alias("edited_fingerprint"),
        likeness(F.col("p"), F.col("q")).alias("near_edited"),
        likeness(F.col("p"), F.col("next_p")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLE: dict[str, str] = {}
