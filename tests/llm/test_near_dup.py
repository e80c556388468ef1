import random
import re
from collections import Counter

import numpy as np
import pytest
from cuewright.llm import near_dup as N


def brute_set(text):
    words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "").encode())]
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows, threshold=75):
    """(n_shingles, component_id, links between classes) of each row."""
    sets = [brute_set(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if rows[x][0] is None or rows[y][0] is None or not a or not b:
                continue
            if 100 * len(a & b) >= threshold * len(a | b):
                p, q = find(rows[x][0]), find(rows[y][0])
                root[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)]


def corpus(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    text = lambda n: rng.choices(words, k=n)
    texts = [text(rng.randint(0, 120)) for _ in range(60)]
    passage = text(60)
    texts += [text(30) + passage + text(rng.randint(0, 20)) for _ in range(30)]
    base = text(200)
    for _ in range(80):  # a chain of edits: neighbours are alike, ends are not
        base = list(base)
        for _ in range(3):
            base[rng.randrange(len(base))] = rng.choice(words)
        texts.append(base)
    texts += [texts[5]] * 10 + [[w.upper() for w in texts[6]]] + [text(3)] * 3
    rng.shuffle(texts)
    rows = [(i * 3 % 1009, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "A\tb"), (2005, "a b"), (2006, "É a"), (2007, "é a"), (None, "a b"), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id bigint, text string, set string, kept boolean")
    got = N.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute(rows))
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert len({r["component_id"] for r in got}) < len(rows) - 80


@pytest.mark.parametrize("threshold", [50, 60, 90])
def test_other_thresholds(spark, threshold):
    assert (N.band_rows(50), N.band_rows(75), N.band_rows(90)) == (3, 6, 8)
    rng = random.Random(threshold)
    base, rows = ["v%d" % i for i in range(300)], corpus(3)[:90]
    for k in range(40):  # pairs around the threshold
        text = [f"{k}{w}" for w in base]
        other = list(text)
        share = threshold / 100 + (k % 9 - 4) / 50
        for at in range(int(296 * (1 - share) / (1 + share) / 5) + 1):
            other[(at * 7 + rng.randrange(7)) % 300] = "x"
        rows += [(5000 + 2 * k, " ".join(text)), (5001 + 2 * k, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = N.near_duplicates(docs, threshold=threshold).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute(rows, threshold))
    assert 0 < sum(r["doc_id"] == 5001 + 2 * k and not r["kept"] for r in got for k in range(40)) < 40


def test_repeated_ids_and_empty(spark):
    a, b = " ".join("a%d" % i for i in range(40)), " ".join("b%d" % i for i in range(40))
    rows = [(1, a), (1, a), (5, a), (5, b), (7, b), (8, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in N.near_duplicates(docs).collect())
    assert got == Counter({(1, 1): 2, (5, 1): 2, (7, 1): 1, (8, 8): 1})
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for shared in (0, 500, 800, 1000):
        x, y = np.unique(pool[:1000]), np.unique(np.concatenate([pool[:shared], pool[1000 : 2000 - shared]]))
        true = shared / (2000 - shared)
        bits = [N.signature(s)[1].tolist() for s in (x, y)]
        row = spark.createDataFrame([tuple(bits)], "x array<bigint>, y array<bigint>").select(N.estimate(N.F.col("x"), N.F.col("y")).alias("e")).first()
        assert abs(row["e"] - true) < 0.2
        same = (N.signature(x)[0] == N.signature(y)[0]).any()
        assert same == (shared > 500) or shared == 500


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "a bigint, b bigint")
    got = {r["id"]: r["root"] for r in N.components(links).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and got[200] == got[300] == 100
