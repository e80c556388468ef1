"""Mixes sources to target weights along a low-discrepancy schedule. DataFrame and SQL functions only.

Slots are numbered; the point frac(i · φ) of slot i falls into one source's share of the cumulative
target weights, so that every prefix of the schedule is near the targets. A source's texts, in a
shuffled order, form one line of words cut into blocks of BLOCK words (the last may be shorter).
Passes over the shuffled blocks, a shorter one last in each, form the source's stream. As many words
of it as the source's target are shared evenly among the slots that the source has, so that each
source meets its target to the word. A source is given a slot for each BLOCK words of its target,
and FEW at least: more than the points can miss, so that no source goes without.

Ranks and running sums are taken in two steps, over small runs and then over the totals of the
runs, so that no source, however large, is summed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, read, written

BLOCK, SHARE, MOST = 2048, 1.5, 2
#: Runs of a source's shuffled line, and slots of a run of the schedule.
RUNS, SLOTS = 4096, 4096
#: Least slots of a source.
FEW = 32
#: Runs of documents of about a size, and the unit of shares of a document.
PARTS, ONE = 64, 1 << 30
#: Frac of the golden ratio in units of 2^-62, and primes over any count of blocks.
GOLDEN = 2850178704830799621
PRIMES = (2147483629, 2147483587)


def words(text: Column) -> Column:
    """How many runs of characters other than space, tab, LF, VT, FF, CR."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACES.replace("[", "[^") + "+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources by code point, null last, have the weights in turn and split share of all sizes; targets
    stop at most times their source's size and the excess is shared again by weight until none is
    above, which is min(most · size, level · weight) for the one level that uses up the total.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))  # rows: sources
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", most * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
    # the level is the first at which the next source isn't filled; before it all are
    found = rows.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"]
    return found.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(first, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def lined_up(sized: DataFrame, seed: int) -> DataFrame:
    """Adds begin: the words before the document in its source's shuffled line."""
    mixed = F.xxhash64(F.lit(seed), "doc_id", "size", "row")
    rows = sized.withColumn("at", mixed).withColumn("run", F.shiftrightunsigned("at", 64 - RUNS.bit_length() + 1).cast("int"))
    totals = rows.groupBy("source", "run").agg(F.sum("size").alias("n"))
    by_source = Window.partitionBy("source").orderBy("run")  # at most RUNS rows a source
    before = totals.select("source", "run", (F.sum("n").over(by_source) - F.col("n")).alias("before"))
    in_run = Window.partitionBy("source", "run").orderBy("at", "doc_id", "row")
    placed = rows.withColumn("within", F.sum("size").over(in_run) - F.col("size"))
    same = placed["source"].eqNullSafe(before["source"]) & (placed["run"] == before["run"])
    return placed.join(before, same).select(
        placed["doc_id"], placed["row"], placed["hash"], placed["size"], placed["source"], (F.col("within") + F.col("before")).alias("begin")
    )


def schedule(spark: SparkSession, shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, rank): the slots of the mix in order, with each one's rank in its source.

    shares: (source, target). The schedule has as many slots as the targets have blocks.
    """
    total = shares.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("t")).first()["t"]
    n = int(-(-total // block))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))  # rows: sources
    until = F.sum("target").over(by_name) / F.lit(total or 1.0)
    ranges = shares.select("source", until.alias("until"), (until - F.col("target") / F.lit(total or 1.0)).alias("since"), F.row_number().over(by_name).alias("k"))
    # sources are few; their ranges are one array, searched for the point of each slot
    table = ranges.agg(F.array_sort(F.collect_list(F.struct("k", "until", "source"))).alias("ranges"))
    tasks = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    point = _golden(F.col("slot")) / F.lit(float(1 << 31))
    slots = spark.range(0, n, 1, tasks).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("ranges", table.scalar())
    hit = F.coalesce(F.element_at(F.filter("ranges", lambda r: r["until"] > F.col("point")), 1), F.element_at("ranges", -1))
    named = slots.select("slot", hit["source"].alias("source")).withColumn("run", F.floor(F.col("slot") / SLOTS))
    totals = named.groupBy("source", "run").agg(F.count("*").alias("n"))
    before = totals.select("source", "run", (F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("run", "source").orderBy("slot")) - 1
    ranked = named.withColumn("within", within)
    same = ranked["source"].eqNullSafe(before["source"]) & (ranked["run"] == before["run"])
    return ranked.join(before, same).select("slot", ranked["source"], (F.col("within") + F.col("before")).alias("rank"))


def _golden(slot: Column) -> Column:
    """frac(slot · φ) in units of 2^-31, in integers: slot · G mod 2^62 by halves of 31 bits."""
    low, high = GOLDEN % (1 << 31), GOLDEN >> 31
    a, b = slot % (1 << 31), F.shiftright(slot, 31)
    carry = F.shiftright(a * F.lit(low), 31)
    return (carry + (a * F.lit(high)) % (1 << 31) + (b * F.lit(low)) % (1 << 31)) % (1 << 31)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(order, documents).

    documents: (doc_id, row, hash, size, source, source_size, target, begin); order: (slot, source, doc_id,
    row, since, until): the words since..until - 1 of a document that a slot takes, slots in order.

    Null texts have size 0, a null source is a source; rows of equal ids are documents of their own
    (row tells them apart); other columns are left out; an empty table gives empty results.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("h"))
    twin = Window.partitionBy("doc_id", "source", "size", "h").orderBy("h")
    sized = written(picked.select("doc_id", "source", "size", F.col("h").alias("hash"), F.xxhash64("h", "source", F.row_number().over(twin)).alias("row")), "sizes")
    shares = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    shares = written(shares, "shares")
    line = written(lined_up(sized, seed), "line")
    asked = shares.where("target > 0").select("source", (F.greatest(F.ceil(F.col("target") / block), F.lit(FEW)) * F.lit(float(block))).alias("target"))
    plan = written(schedule(spark, asked, block), "schedule")
    counts = plan.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("slots"))
    streams = shares.join(F.broadcast(counts), shares["source"].eqNullSafe(counts["s"])).select(
        "s", "slots", F.col("source_size").alias("n"), F.round("target").cast("bigint").alias("words"), (F.abs(F.xxhash64(F.lit(seed), "source")) % 1000003).alias("turn")
    )
    # slot k takes the words k · words / slots .. of the stream, rounded down
    share, rest = F.expr("words div slots"), F.col("words") % F.col("slots")
    edge = lambda k: k * share + F.floor(k * rest / F.col("slots"))
    ranges = plan.join(F.broadcast(streams), plan["source"].eqNullSafe(streams["s"])).withColumn("low", edge(F.col("rank"))).withColumn("high", edge(F.col("rank") + 1))
    # a range meets blocks number g of the stream: number step of a pass, m a pass, whole ones of them of full length
    m, whole = F.ceil(F.col("n") / block), F.floor(F.col("n") / block)
    number = lambda x: F.floor(x / F.col("n")) * m + F.floor(x % F.col("n") / block)
    pieces = ranges.where("low < high").withColumn("g", F.explode(F.sequence(number(F.col("low")), number(F.col("high") - 1))))
    trip, step = F.floor(F.col("g") / m), F.col("g") % m
    prime = F.when(trip % 2 == 0, F.lit(PRIMES[0])).otherwise(F.lit(PRIMES[1]))
    # whole blocks come in the order (step · prime + turn) mod whole
    at = F.when(step < whole, (step * prime + F.col("turn") * (trip + 1)) % whole).otherwise(step)
    start = trip * F.col("n") + step * block
    length = F.least(F.lit(block), F.col("n") - step * block)
    taken = pieces.select(
        "slot", "s", at.alias("block"), (at * block + F.greatest(F.col("low") - start, F.lit(0))).alias("low"), (at * block + F.least(F.col("high") - start, length)).alias("high")
    )
    parts = line.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)))
    )
    hit = taken.join(parts, taken["s"].eqNullSafe(parts["source"]) & (taken["block"] == parts["block"]))
    since = F.greatest(F.col("begin"), F.col("low"))
    until = F.least(F.col("begin") + F.col("size"), F.col("high"))
    order = hit.where(since < until).select("slot", "source", "doc_id", "row", (since - F.col("begin")).alias("since"), (until - F.col("begin")).alias("until"))
    small = shares.select(F.col("source").alias("s"), "source_size", "target")
    listed = line.join(F.broadcast(small), line["source"].eqNullSafe(small["s"])).drop("s")
    return order, listed


def taken_words(order: DataFrame, listed: DataFrame) -> DataFrame:
    """listed with taken: the words that the mix takes of each document, repeats counted."""
    sums = order.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.sum(F.col("until") - F.col("since")).alias("n"))
    joined = listed.join(sums, listed["doc_id"].eqNullSafe(sums["d"]) & (listed["row"] == sums["r"]), "left")
    return joined.select(*listed.columns, F.coalesce("n", F.lit(0)).alias("taken"))


def whole_copies(taken: DataFrame) -> DataFrame:
    """(doc_id, source, hash, copies, n): how many copies the n rows of a key have together, from taken_words().

    Along a source's documents by size, taken / size is summed and each document has as many copies as the
    rounded sum rises by: the share kept of long documents is that of short ones, and what is
    rounded up or down is made good by the next document of about that size. Texts without words stay once.
    """
    # runs: sizes of about an eighth of a doubling, cut by hash
    by_size = F.floor(8 * F.log2(F.col("size").cast("double"))) * PARTS + F.shiftrightunsigned("at", 65 - PARTS.bit_length())
    rows = taken.select("doc_id", "source", "hash", "row", "size", "taken", F.xxhash64("doc_id", "row", "hash").alias("at"))
    rows = rows.withColumn("run", by_size).withColumn("part", F.round(F.col("taken") / F.col("size") * ONE).cast("bigint"))
    some = written(rows.where("size > 0"), "parts")
    totals = some.groupBy("source", "run").agg(F.sum("part").alias("n"))
    before = totals.select(F.col("source").alias("s"), F.col("run").alias("r"), (F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n")).alias("before"))
    within = F.sum("part").over(Window.partitionBy("source", "run").orderBy("at", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0))
    placed = some.withColumn("within", within)
    summed = placed.join(before, placed["source"].eqNullSafe(before["s"]) & (placed["run"] == before["r"]))
    until = F.col("before") + F.col("within") + ONE // 2
    copies = (F.shiftright(until, ONE.bit_length() - 1) - F.shiftright(until - F.col("part"), ONE.bit_length() - 1)).alias("copies")
    empty = rows.where("size = 0").select("doc_id", "source", "hash", F.lit(1).cast("bigint").alias("copies"))
    both = summed.select("doc_id", "source", "hash", copies).unionByName(empty)
    return both.groupBy("doc_id", "source", "hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))


def repeated_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, in whole copies as whole_copies() has them.

    Rows of equal id, source and text share their copies as evenly as whole copies go.
    """
    key = [F.col(id_col).alias("d"), F.col(source_col).alias("s"), F.xxhash64(F.col(text_col)).alias("h")]
    order, listed = mix(docs, weights, id_col, text_col, source_col)
    times = written(whole_copies(taken_words(order, listed)).where("copies > 0"), "times")
    marked = docs.select(F.struct(*docs.columns).alias("whole"), *key)

    def found(some: DataFrame) -> DataFrame:
        same = marked["d"].eqNullSafe(some["doc_id"]) & marked["s"].eqNullSafe(some["source"]) & (marked["h"] == some["hash"])
        return marked.join(some, same).select("whole", "d", "s", "h", "copies", "n")

    turn = F.row_number().over(Window.partitionBy("d", "s", "h").orderBy("h")) - 1
    twins = found(times.where("n > 1")).withColumn("own", F.expr("copies div n") + (turn < F.col("copies") % F.col("n")).cast("bigint"))
    each = found(times.where("n = 1")).withColumn("own", F.col("copies")).unionByName(twins).where("own > 0")
    return each.select("whole", F.explode(F.sequence(F.lit(1), F.col("own").cast("int"))).alias("copy")).select("whole.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(*mix(read(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op6_mixing": op6_mixing}
ORACLE: dict[str, str] = {}
