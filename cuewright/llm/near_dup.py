"""MinHash near-duplicate detection with b-bit signatures.

A text's set is its distinct five-word shingles. Each set gets COARSE minima of random
permutations, cut into bands. Rows of a band are hashed to a band key; texts that share one are candidates. Of each
minimum BITS bits are kept; packed into longs, the signatures of two candidates give by bit counts
the share E of equal minima, which corrected for chance agreement estimates their similarity:
J = (E - C) / (1 - C) with C = 2^-BITS. Candidates whose estimate isn't far below the threshold, and whose
sets aren't too unequal in size to reach it, are confirmed on their full sets.

Bands are as long as the threshold allows (band_rows): at 0.75 there are 64 of 6 minima, which miss a pair right
at the threshold with probability 4e-6; the slack of the estimate is four and a half deviations, 3e-6.

Never all pairs of a group: texts of equal sets are one class from the start. Every class is then
compared with one member of each of its band groups, by a hash of its own order in each band, links are confirmed, and components
formed. Only where a band group then still spans several components, its members outside the
group's chief component are compared with the others, so no link between components stays unseen
while the copies that are already joined cost nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

WORDS, THRESHOLD = 5, 75
BITS = 2
#: Minima of the signatures that go with the bands, and of the finer ones where groups stay apart.
COARSE, FINE = 384, 1920
#: The chance with which bands may miss a pair right at the threshold.
MISSED = 5e-6
_CHANCE = 0.5**BITS


def band_rows(threshold: int) -> int:
    """The most minima a band can have: COARSE of them in such bands miss hardly a pair at the threshold."""
    fitting_ = [k for k in range(1, COARSE + 1) if COARSE % k == 0 and (1 - (threshold / 100) ** k) ** (COARSE // k) <= MISSED]
    return max(fitting_, default=1)


def least_estimate(minima: int, threshold: int = THRESHOLD) -> float:
    """Estimates under this can't be confirmed, but for a chance of 3e-6."""
    equal = threshold / 100 * (1 - _CHANCE) + _CHANCE
    return threshold / 100 - 4.5 * (equal * (1 - equal) / minima) ** 0.5 / (1 - _CHANCE)


#: Members of a pivot's verification group: the pivot's set is sent once for so many.
CHUNK = 64
#: Ids that may be broadcast, 8 bytes each.
IDS = 250_000
#: Edges of one file of a round's table.
EDGES = 500_000


# ---- sets and signatures ------------------------------------------------------------------------

_words: dict[bytes, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    get = _words.get
    found = [get(w) for w in words]
    if None in found:
        for w in set(words):
            if w not in _words:
                if len(_words) > 300_000:
                    _words.clear()
                _words[w] = xxh3_64_intdigest(w)
        found = [get(w) or xxh3_64_intdigest(w) for w in words]
    return np.array(found, np.uint64)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words the whole sequence is one."""
    h = word_hashes(text)
    if len(h) == 0:
        return h
    n = max(1, len(h) - width + 1)
    mixed = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        mixed = _stir(mixed + h[k : k + n])
    return np.unique(mixed)


_rng = np.random.default_rng(20240101)
_A = (_rng.integers(0, 1 << 32, FINE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 1 << 32, FINE, dtype=np.uint64).astype(np.uint32)[:, None]


def minima(found: np.ndarray, n: int = COARSE) -> np.ndarray:
    """The least value of each of n permutations over the set."""
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        x = low[None, at : at + 1024] * _A[:n]
        x += _B[:n]
        np.minimum(best, x.min(axis=1), out=best)
    return best


def signature(found: np.ndarray, per_band: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, low bits of the minima packed into longs)."""
    best = minima(found)
    rows = best.reshape(-1, per_band).astype(np.uint64)
    keys = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(per_band):
        keys = _stir(keys + rows[:, k])
    return keys.view(np.int64), packed(best)


def packed(best: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum as longs: the first bits of all, then the second ones.

    Multiplication leaves low bits regular, so the bits are those of a stirred minimum.
    """
    stirred = _stir(best.astype(np.uint64) + np.arange(len(best), dtype=np.uint64))
    bits = np.concatenate([(stirred >> np.uint64(k)) & np.uint64(1) for k in range(BITS)]).astype(np.uint8)
    return np.packbits(bits).view(">i8").astype(np.int64)


def fine_signatures(texts: DataFrame) -> DataFrame:
    """(id, fine): the longer packed signature of each text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fine = [packed(minima(shingles(t), FINE)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.list_(pa.int64()))], names=["id", "fine"])

    return texts.select("id", "t").mapInArrow(run, "id bigint, fine array<bigint>").dropDuplicates(["id"])


def sketches(docs: DataFrame, id_col: str, text_col: str, threshold: int = THRESHOLD) -> DataFrame:
    """(id, n, set, bands, bits) of each row; set is a 128-bit hash of the shingle set, null if it is empty."""
    per_band = band_rows(threshold)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_hexdigest

        longs = pa.list_(pa.int64())
        for batch in batches:
            n, names, bands, bits = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                n.append(len(found))
                names.append(xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
                keys, packed = signature(found, per_band) if len(found) else (None, None)
                bands.append(keys)
                bits.append(packed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(bands, longs), pa.array(bits, longs)], names=["id", "n", "set", "bands", "bits"]
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    return rows.mapInArrow(run, "id bigint, n bigint, set string, bands array<bigint>, bits array<bigint>")


# ---- candidates ---------------------------------------------------------------------------------


def estimate(a: Column, b: Column, n: int = COARSE) -> Column:
    """Similarity from the packed bits of n minima: the equal ones, corrected for chance agreement."""
    plane = n // 64

    def differ(k) -> Column:
        some = F.get(a, k).bitwiseXOR(F.get(b, k))
        for j in range(1, BITS):
            some = some.bitwiseOR(F.get(a, k + j * plane).bitwiseXOR(F.get(b, k + j * plane)))
        return F.bit_count(some)

    if n == COARSE:
        unequal = differ(0)
        for k in range(1, plane):
            unequal = unequal + differ(k)
    else:  # a loop: spelled out, it would be too long to compile
        unequal = F.aggregate(F.sequence(F.lit(0), F.lit(plane - 1)), F.lit(0), lambda held, k: held + differ(k))
    return (1 - unequal / F.lit(float(n)) - _CHANCE) / (1 - _CHANCE)


def fitting(n: Column, m: Column, threshold: int) -> Column:
    """Whether sets of such sizes can reach the threshold."""
    return 100 * F.least(n, m) >= threshold * F.greatest(n, m)


def members(classes: DataFrame) -> DataFrame:
    """(band, id, pivot) of each class in each band group of two or more, from (id, bands)."""
    keys = classes.select("id", F.explode("bands").alias("band"))
    mixed = F.struct(F.xxhash64("id", "band").alias("h"), F.col("id").alias("id"))
    shared = keys.groupBy("band").agg(F.count("*").alias("n"), F.min(mixed).alias("m")).where("n > 1")
    return keys.join(shared, "band").select("band", "id", F.col("m.id").alias("pivot"))


def pivot_pairs(groups: DataFrame, bits: DataFrame, threshold: int) -> DataFrame:
    """(a, b, e): each class with the pivot of each of its groups, as far as the estimate e allows."""
    pairs = groups.where("id <> pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
    return estimated(pairs, bits, threshold)


def estimated(pairs: DataFrame, bits: DataFrame, threshold: int) -> DataFrame:
    left = bits.select(F.col("id").alias("a"), F.col("bits").alias("x"), F.col("n").alias("nx"))
    right = bits.select(F.col("id").alias("b"), F.col("bits").alias("y"), F.col("n").alias("ny"))
    joined = pairs.join(left, "a").join(right, "b").where(fitting(F.col("nx"), F.col("ny"), threshold))
    return joined.select("a", "b", estimate(F.col("x"), F.col("y")).alias("e")).where(F.col("e") >= least_estimate(COARSE, threshold))


# ---- confirmation -------------------------------------------------------------------------------


def alike(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    same = np.intersect1d(x, y, assume_unique=True).size
    return len(x) > 0 and 100 * same >= threshold * (len(x) + len(y) - same)


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) of the pairs whose full sets satisfy 100 · intersection >= threshold · union.

    Texts go to groups of a first member and up to CHUNK others, chosen by hash, so that a text with
    many pairs is sent once for many of them and no group grows with the pairs of one text.
    """
    spread = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(spread, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).alias("g"))
    dealt = written(dealt, "pairs")
    first = dealt.select("a", "g").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "g", F.lit(None).cast("bigint").alias("b"), "t")
    others = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "g", "b", "t")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = first.unionByName(others).repartition(tasks, "a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group, own = None, []  # rows of equal id give a pair several first texts
        for batch in batches:
            hits: list[tuple[int, int]] = []
            for a, g, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingles(text)
                if b is None:
                    group, own = (a, g), [*own, found] if group == (a, g) else [found]
                    continue
                assert group == (a, g)
                if any(alike(x, found, threshold) for x in own):
                    hits.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


# ---- components ---------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(id, root) of each id with a link, root the least id it reaches; by large and small stars.

    Each round is a grouped minimum and a join, both spread over ids; rounds are logarithmic.
    """
    files = max(1, -(-links.count() // EDGES))
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().coalesce(files), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct().coalesce(files), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id has one edge down or is only reached from above: no id is both or has two."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id, kept, links) of each row.

    component_id: the least id that confirmed links reach, the row's own included; links: those
    found of its class to others. Texts without words have no links. Rows of equal id count as one
    document for links, each with the size of its own set. A null id has a null component, no links,
    and is kept. Other columns are left out; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    sketch = written(sketches(docs, id_col, text_col, threshold), "sketches")
    known = sketch.where("id IS NOT NULL AND set IS NOT NULL")
    ranked = known.groupBy("set").agg(F.min("id").alias("rep"))
    chosen = ranked.select("set", F.col("rep").alias("id"))
    classes = written(known.select("id", "set", "n", "bands", "bits").join(chosen, ["id", "set"]).dropDuplicates(["id", "set"]), "classes")
    bits = classes.select("id", "n", "bits")
    groups = written(members(classes), "groups")

    def links_of(pairs: DataFrame, found: DataFrame) -> DataFrame:
        return written(confirmed(pairs, found, threshold).distinct(), "links")

    sets = known.select("id", "set").distinct()
    # rows that share an id join their classes
    same_id = sets.join(ranked, "set").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("all")).where("a <> b")
    joined = same_id.select("a", F.explode("all").alias("b")).where("a <> b")

    pairs = written(pivot_pairs(groups, bits, threshold), "pivots")
    near = texts_of(texts, pairs)
    # first the likeliest pivot of each, then those that would still join two components
    ends = pairs.select("a", "b", "e", F.explode(F.array("a", "b")).alias("id"))
    best = ends.groupBy("id").agg(F.max(F.struct("e", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("m"))
    best = written(best.select((-F.col("m.a")).alias("a"), (-F.col("m.b")).alias("b")).distinct(), "likeliest")
    links = written(links_of(best, near).unionByName(joined.select("a", "b")), "links")
    roots = components(links)
    rest = across(pairs.join(best, ["a", "b"], "left_anti").select("a", "b"), roots)
    links = written(links.unionByName(links_of(rest, near)), "links")
    roots = components(links)
    tested = pairs.select("a", "b")
    rest = written(strays(groups, roots, bits, texts, threshold).join(tested, ["a", "b"], "left_anti"), "strays")
    more = None if rest.isEmpty() else links_of(rest, texts_of(texts, rest))
    if more is not None and not more.isEmpty():
        links = written(links.unionByName(more), "links")
        roots = components(links)

    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    counted = ends.groupBy("id").agg(F.count("*").alias("links"))
    of_class = ranked.join(roots, ranked["rep"] == roots["id"], "left").drop("id").join(counted, F.col("rep") == counted["id"], "left")
    # as a table, so that the join below is one of two plain exchanges, which Spark splits where a class is large
    of_class = written(of_class.select("set", F.coalesce("root", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links")), "class-components")
    out = sketch.select("id", "n", "set").join(of_class, "set", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).alias("links"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each group of near copies.

    The row of a group's least id stays; of rows that repeat an id, one does. Rows without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col)
    marked = written(found.select(F.col(id_col).alias("id"), "kept"), "kept")
    drop = written(marked.where("NOT kept").select("id").distinct(), "dropped")
    again = written(marked.where("kept AND id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    key = F.col(id_col).cast("bigint")
    stay = docs.join(F.broadcast(drop) if drop.count() <= IDS else drop, key == drop["id"], "left_anti")
    if again.isEmpty():
        return stay
    once = stay.join(again, key == again["id"], "left_anti")
    order = Window.partitionBy(key).orderBy(F.col(text_col).desc_nulls_last())
    twice = stay.join(again, key == again["id"], "left_semi").withColumn("place in id", F.row_number().over(order)).where("`place in id` = 1")
    return once.unionByName(twice.drop("place in id"))


def texts_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that occur in pairs, as a table. Up to IDS ids are broadcast; more are joined by a shuffle."""
    ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "near-ids")
    return written(texts.join(F.broadcast(ids) if ids.count() <= IDS else ids, "id", "left_semi"), "near-texts")


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component."""
    left, right = (roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    return joined.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def strays(groups: DataFrame, roots: DataFrame, coarse: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b): members of a band group outside its chief component with members of other components there.

    These are told by the finer signatures, so that what can't be a link is seldom sent to confirmation; a
    pair comes from the first of its common groups alone.
    """
    rooted = groups.join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    parts = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
    chief = parts.groupBy("band").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    open_ = written(rooted.join(chief.select("band", F.col("m.root").alias("chief")), "band"), "open")
    near = texts_of(texts, open_.select(F.col("id").alias("a"), F.col("id").alias("b")))
    marks = open_.groupBy("id").agg(F.collect_list("band").alias("bands")).join(fine_signatures(near), "id").join(coarse.dropDuplicates(["id"]), "id")
    rows = written(open_.join(marks, "id"), "open-marked")
    names = {"id": "i", "root": "r", "n": "n", "bits": "c", "fine": "f", "bands": "b"}
    own = rows.where("root <> chief").select(F.col("band").alias("sband"), *[F.col(c).alias(f"s{k}") for c, k in names.items()])
    other = rows.select("band", (F.col("root") == F.col("chief")).alias("in_chief"), *[F.col(c).alias(f"o{k}") for c, k in names.items()])
    apart = (F.col("sr") != F.col("or")) & (F.col("in_chief") | (F.col("si") < F.col("oi"))) & fitting(F.col("sn"), F.col("on"), threshold)
    # the short signatures spare most pairs the long ones
    like = (estimate(F.col("sc"), F.col("oc")) >= least_estimate(COARSE, threshold)) & (estimate(F.col("sf"), F.col("of"), FINE) >= least_estimate(FINE, threshold))
    # of a pair without a chief in some of its groups each side is a stray in some: both orders are one
    first = F.array_min(F.array_intersect("sb", "ob")) == F.col("sband")
    hit = own.join(other, (F.col("sband") == F.col("band")) & apart & like & first)
    return hit.select(F.least("si", "oi").alias("a"), F.greatest("si", "oi").alias("b")).distinct()


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("links")


QUERIES = {"op5_near_dup": op5_near_dup}
ORACLE: dict[str, str] = {}
