import itertools
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
from cuewright.llm import pitman_yor as Y
from pyspark.sql import functions as F


def seatings(c):
    """All set partitions of c customers, as block sizes."""
    if c == 0:
        yield []
        return
    for rest in seatings(c - 1):
        for k in range(len(rest)):
            yield rest[:k] + [rest[k] + 1] + rest[k + 1 :]
        yield [*rest, 1]


def test_stirling_counts_weighted_seatings():
    d, table = 0.6, Y.stirling(0.6)
    for c in range(1, 7):
        want = Counter()
        for sizes in seatings(c):
            want[len(sizes)] += math.prod(math.prod(j - d for j in range(1, n)) for n in sizes)
        assert all(math.isclose(math.exp(table[c, t]), w) for t, w in want.items())


def test_tables_follow_their_conditional():
    rng, d = np.random.default_rng(3), 0.4
    table = Y.stirling(d)
    for c, a in ((5, 0.7), (30, 3.0)):
        drawn = Y.draw_tables(np.full(40_000, c), np.full(40_000, a), d, table, rng)
        t = np.arange(1, c + 1)
        p = np.exp(table[c, 1 : c + 1]) * a**t
        assert np.abs(np.bincount(drawn, minlength=c + 1)[1:] / 40_000 - p / p.sum()).max() < 0.01
    many = Y.draw_tables(np.full(2000, 5000), np.full(2000, 4.0), d, table, rng)
    assert 1 <= many.min() and many.max() < 5000


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 60, (300, 2)), axis=0)
    rest = Y.Restaurants(pairs[:, 0], pairs[:, 1] % 4, rng.integers(1, 90, len(pairs)), 60, 4, 1)
    for _ in range(3):
        t = rest.totals()
        rest.sweep(t, Y.stirling(t.d0), Y.stirling(t.d1))
    t = rest.totals()
    parent, empty = rest.parent_p(t), 60 - len(np.unique(pairs[:, 0]))
    assert math.isclose(parent.sum() + t.new_word() * Y.UNKNOWN, 1, rel_tol=1e-9) and empty >= 0
    for a in range(4):
        own = (rest.count - t.d1 * rest.tables)[rest.context == a].sum() / (Y.STRENGTH[1] + t.customers[a])
        assert math.isclose(own + t.back_off()[a], 1, rel_tol=1e-9)


def test_contexts():
    hashes = np.array([10, 20, 30], np.uint64) << np.uint64(32)
    numbers = np.array([1, 2, 0, 0, 2, 2, 0])  # texts of 3, 1, 3
    assert Y.contexts_of(numbers, np.array([3, 1, 3]), hashes, 1 << 16).tolist() == [10, 20, 30, 10, 10, 30, 30]
    assert [Y.contexts_for(n) for n in (0, 1000, 10**6, 170 * 10**6, 840 * 10**6, 10**12)] == [256, 256, 1 << 11, 1 << 15, 1 << 16, 1 << 18]


def test_scores_equal_the_model_where_it_is_certain(spark):
    """Each training pair and word occurs once, so every table is known and the probabilities can be written down."""
    words = ["a%d" % i for i in range(30)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, "a3 a4 zz"), (2, "a9 a3"), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in Y.language_scores(docs, F.col("doc_id") > 0).collect()}
    from xxhash import xxh3_64_intdigest

    place = lambda w: (xxh3_64_intdigest(w.encode()) >> 32) % 256
    d, v, chain = 0.95, 31, [" ", *words, " "]
    customers = Counter(place(u) for u in chain[:-1])
    follows = {(place(u), w) for u, w in itertools.pairwise(chain)}
    back = (1 + d * v) / (1 + v)

    def p(u, w):
        parent = (1 - d) / (1 + v) + back * 0.1 / v if w in chain else back * 0.9
        n = customers[place(u)]
        return ((1 - d) * ((place(u), w) in follows) + (1 + d * n) * parent) / (1 + n)

    for key, text in ((0, words), (1, ["a3", "a4", "zz"]), (2, ["a9", "a3"]), (3, [])):
        want = sum(math.log10(p(u, w)) for u, w in itertools.pairwise([" ", *text, " "]))
        assert math.isclose(got[key], want, rel_tol=1e-5), (key, got[key], want)


def test_scores(spark):
    words = ["The", "of", "la", "x1", "x2", "x3", "é", "É", "q,"]
    rows = [(i, " ".join(words[(i * k) % 9] for k in range(1, 12)) + ("\n new%d" % i if i % 5 == 0 else ""), 7) for i in range(150)]
    rows += [(200, None, 7), (201, "", 7), (202, "the " * 20000, 7), (None, "la la", 7), (3, "x1", 7), (3, "x1", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    held = F.col("doc_id") % 7 == 2
    got = Y.language_scores(docs, held).collect()
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b" "]
    out = lambda i: i is not None and i % 7 == 2
    count = Counter(w for i, t, _ in rows if not out(i) for w in split(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), out(i), len(s), sum(w in count for w in s), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s), 6)) for i, t, _ in rows for s in [split(t)])
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    fold = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in fold) > sum(r["base_score"] for r in fold) and all(r["score"] < 0 for r in got)
    again = Y.language_scores(docs.repartition(1), held).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"])
    assert np.allclose([r["score"] for r in sorted(again, key=key)], [r["score"] for r in sorted(got, key=key)])
    nothing = Y.language_scores(docs, F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in nothing} == {(0, 0)} and len(nothing) == len(rows)
    assert Y.language_scores(docs.limit(0), held).count() == 0


def test_buckets_agree_with_one(spark):
    """Counts don't depend on how words fall into buckets."""
    docs = spark.createDataFrame([(i, " ".join("w%d" % (i * j % 40) for j in range(30))) for i in range(60)], "id bigint, t string").withColumn("held", F.col("id") % 3 == 0)
    for buckets in (1, 7):
        table = Y.written(Y.blocks(docs, 256, buckets), "b")
        totals, tokens, words = Y.gather_totals(table.where("bucket >= 0").select("bucket", "block", "data"), 256, buckets)
        assert (tokens, words) == (40 * 31, 41) and totals.customers.sum() == tokens


def test_each_word_has_its_own_restaurant(spark, tmp_path):
    """The query's scores, where every table is certain and a4 and a12 share a restaurant of 256 by hash."""
    from xxhash import xxh3_64_intdigest

    assert len({(xxh3_64_intdigest(w) >> 32) % 256 for w in (b"a4", b"a12")}) == 1
    words = ["a%d" % i for i in range(30)]
    out = [i for i in range(100) if zlib.crc32(b"%d" % i) % 7 == 2]
    known = next(i for i in range(100) if i not in out)
    texts = {known: words, out[0]: ["a4", "a5"], out[1]: ["a4", "a13"], out[2]: ["a3", "zz", "a4"], out[3]: []}
    spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in Y.op9_pitman_yor(spark, str(tmp_path)).collect()}
    d, v, chain = 0.95, 31, [" ", *words, " "]
    follows, back = set(itertools.pairwise(chain)), (1 + d * v) / (1 + v)

    def p(u, w):
        n = u in chain
        return ((1 - d) * ((u, w) in follows) + (1 + d * n) * ((1 - d) / (1 + v) + back * 0.1 / v if w in chain else back * 0.9)) / (1 + n)

    for key, text in texts.items():
        want = sum(math.log10(p(u, w)) for u, w in itertools.pairwise([" ", *text, " "]))
        assert math.isclose(got[key], want, rel_tol=1e-5), (key, got[key], want)


def test_contexts_are_not_bounded():
    n = Y.CONTEXTS[1] + 1000
    _, requests = Y.pairs_of([Y.END, *(b"%d" % i for i in range(n))], [np.r_[1 : n + 1, 0]], [False], None, 3)
    sizes = [struct.unpack_from("<5I", data) for _, data in requests]
    keys = [Y.opened_keys(data[20 + s[0] : 20 + s[0] + s[1]]) for s, (_, data) in zip(sizes, requests)]
    assert len(np.unique(np.concatenate(keys))) == n + 1


def test_buckets_get_the_totals_of_their_contexts(spark):
    """Over several blocks, buckets and shards: customers are exact, tables between distinct followers and customers."""
    from xxhash import xxh3_64_intdigest

    place = lambda w: xxh3_64_intdigest(w.encode())
    rows = [(i, " ".join("w%d" % (i * j % 97) for j in range(1, 40))) for i in range(120)]
    follows = Counter((place(u), w) for i, t in rows if i % 3 for u, w in itertools.pairwise([" ", *t.split(), " "]))
    customers, distinct = Counter(), Counter()
    for (u, _), n in follows.items():
        customers[u] += n
        distinct[u] += 1
    docs = spark.createDataFrame(rows, "id bigint, t string").repartition(3).withColumn("held", F.col("id") % 3 == 0)
    buckets = 20
    table = Y.written(Y.blocks(docs, None, buckets), "b")
    requests = table.where("bucket >= 0").select("bucket", "block", "data")
    found = Y.context_totals(requests, buckets)
    totals, tokens, words = Y.totals_of(found)
    assert len(totals.customers) == 3 and totals.customers.sum() == tokens == sum(follows.values()) and words == len({w for _, w in follows})
    assert sum(distinct.values()) <= totals.tables.sum() <= tokens
    for bucket in range(buckets):
        asked = requests.where(F.col("bucket") == bucket)
        if asked.count():
            keys = Y._gathered(asked.toArrow())[-1].tolist()
            sent = sorted(found.where(F.col("bucket") == bucket).collect(), key=lambda r: r["shard"])
            got, tables = (np.concatenate([Y.opened(bytes(r[name]), "<i8") for r in sent]) for name in ("customers", "tables"))
            assert got.tolist() == [customers[k] for k in keys]
            assert all(distinct[k] <= t / Y.KEPT <= customers[k] for k, t in zip(keys, tables.tolist(), strict=True))


def test_tables_beyond_a_bucket():
    """A dish counts its own tables once, and the context's other dishes for those in the other buckets."""
    rest = Y.Restaurants(np.array([0, 1, 2]), np.array([0, 1, 1]), np.array([5, 6, 7]), 3, 2, 1)
    rest.tables = np.array([3, 1, 2])
    assert rest.tables_beyond(10).tolist() == [3, 21, 12] and rest.tables_beyond(1).tolist() == [3, 3, 3]


def test_scores_agree_with_one_sampler(spark, monkeypatch):
    """Many buckets given totals score as one process that holds every restaurant and follows its own totals."""
    rng = np.random.default_rng(5)
    texts = [" ".join("w%d" % (k % 60) for k in np.cumsum(rng.zipf(1.6, 40) % 60)) for _ in range(300)]
    chains = [[" ", *t.split(), " "] for t in texts]
    held = lambda i: i % 4 == 0
    names = {w: n for n, w in enumerate(sorted({w for i, c in enumerate(chains) if not held(i) for w in c}))}
    follows = Counter((names[w], names[u]) for i, c in enumerate(chains) if not held(i) for u, w in itertools.pairwise(c))
    pairs, count = np.array(list(follows)), np.array(list(follows.values()))
    rest = Y.Restaurants(pairs[:, 0], pairs[:, 1], count, len(names), len(names), 1)
    mean, sweeps = np.zeros((len(names), len(names))), 60
    for k in range(10 + sweeps):
        t = rest.totals()
        rest.sweep(t, Y.stirling(t.d0), Y.stirling(t.d1))
        if k >= 10:
            t = rest.totals()
            p = np.outer(rest.parent_p(t), t.back_off())
            p[rest.word, rest.context] += (rest.count - t.d1 * rest.tables) / (Y.STRENGTH[1] + t.customers[rest.context])
            mean += p / sweeps
    monkeypatch.setattr(Y, "BUCKET_CHARS", len(" ".join(texts)) // 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in Y.language_scores(docs, F.col("doc_id") % 4 == 0, whole=True).collect()}
    for i, c in enumerate(chains):
        if all(w in names for w in c):
            want = np.mean([math.log10(mean[names[w], names[u]]) for u, w in itertools.pairwise(c)])
            assert abs(got[i] / (len(c) - 1) - want) < 0.03, (i, got[i] / (len(c) - 1), want)
