import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from cuewright.llm import fingerprints as I


def h64(value, seed=42):
    raw = value.encode() if isinstance(value, str) else (value & (2**64 - 1)).to_bytes(8, "little")
    x = xxhash.xxh64_intdigest(raw, seed)
    return x - 2**64 if x >> 63 else x


def brute_terms(text):
    return {h64(t) for t in re.split(I.SPLIT, (text or "").lower()) if t}


def brute_parts(text, lexicon):
    found = brute_terms(text)
    kept = sorted(found & lexicon or found)
    out, bit = [], 4
    for j, bits in enumerate(I.SUBSETS):
        part = [t for t in kept if not (t >> bit) & ((1 << bits) - 1)]
        seed = xxhash.xxh64_intdigest(j.to_bytes(4, "little"), 42)
        for t in part:
            seed = h64(t, seed & (2**64 - 1)) & (2**64 - 1)
        out.append(f"{seed:016x}" if part else "-")
        bit += bits
    return out


def near(a, b):
    pairs = [(x, y) for x, y in zip(a, b) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


@pytest.mark.parametrize("partitions, constant", [("1", 10**6), ("5", 10**6), ("5", 0)])
def test_equals_brute_force(spark, partitions, constant):
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(300)] + ["Ä", "ß"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "a", "?!", "X-y z, x", "😀é" * 9, texts[0], "w1 " * 3000]
    rows = [(i * 7 % 1000 - 5, t, i) for i, t in enumerate(texts)] + [(3, "twin", 0), (3, "twin", 0), (3, "other", 0)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint int")
        got = I.fingerprints(docs, low=1.0, high=4.0, constant=constant).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = sorted((i, t or "") for i, t, _ in rows)
    df = Counter(h for _, t in ordered for h in brute_terms(t))
    lexicon = {h for h, n in df.items() if 1.0 <= math.log(len(ordered) / n) <= 4.0}
    assert 0 < len(lexicon) < len(df)
    want = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + following[:q]
        p, p2, p3 = (brute_parts(x, lexicon) for x in (t, e, following))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), ".".join(p), ".".join(p2), near(p, p2), near(p, p3)))
    assert sorted(map(tuple, got)) == sorted(want)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "abcd efgh"), (None, None), (4, "ab")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["n_chars"]): r for r in I.fingerprints(docs).collect()}
    assert got[(None, 0)]["near_edited"] == 1.0
    assert got[(4, 2)]["edited_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert got[(None, 9)]["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()
    one = I.fingerprints(docs.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert I.fingerprints(docs.limit(0)).count() == 0
