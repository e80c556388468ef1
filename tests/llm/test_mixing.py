import math
import re
from collections import Counter

import pytest
from cuewright.llm import mixing as M


def brute_targets(sizes, weights):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, got = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while free and left > 1e-9:
        whole = sum(w[s] for s in free)
        share = {s: got[s] + left * w[s] / whole for s in free}
        left = sum(max(0, v - 2 * sizes[s]) for s, v in share.items())
        got |= {s: min(v, 2 * sizes[s]) for s, v in share.items()}
        free = {s for s in free if got[s] < 2 * sizes[s] - 1e-9}
    return got


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, None: 10}, {"a": 1, "B": 1000, "c": 5, "d": 0, "é": 70}, {"x": 7}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in M.targets(df, (3, 1, 2)).collect()}
    assert got == pytest.approx(brute_targets(sizes, (3, 1, 2)))


def test_schedule_is_even(spark):
    shares = spark.createDataFrame([("a", 6000.0), ("b", 3000.0), (None, 1000.0)], "source string, target double")
    rows = sorted(M.schedule(spark, shares, 10).collect())
    assert [r["slot"] for r in rows] == list(range(1000))
    seen, golden = Counter(), (math.sqrt(5) - 1) / 2
    for r in rows:
        assert r["rank"] == seen[r["source"]]
        seen[r["source"]] += 1
        for s, share in (("a", 0.6), ("b", 0.3), (None, 0.1)):
            assert abs(seen[s] - share * (r["slot"] + 1)) < 5
        point = r["slot"] * golden % 1
        assert r["source"] == ("a" if point < 0.6 else "b" if point < 0.9 else None)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 40)), "s%d" % (i % 7 % 3), 0) for i in range(400)]
    rows += [(400, None, "s0", 0), (401, "", None, 0), (402, "a\tb\x0bc  d e\n", None, 0), (403, "x " * 5000, "s1", 0), (5, "w w", "s2", 0), (5, "w w", "s2", 0), (None, "q q", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    order, listed = M.mix(docs, block=8)
    got = M.taken_words(order, listed).collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    per, want, target = Counter(), Counter(), {}
    for r in got:
        if r["doc_id"] != 5:
            assert r["size"] == size[r["doc_id"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        per[r["source"]] += r["taken"]
        want[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == want[r["source"]] for r in got)
    assert target == pytest.approx(brute_targets(want, (3, 1, 2)))
    for s in per:
        assert abs(per[s] - target[s]) <= 8 * 6
    spans = order.collect()
    assert all(0 < r["until"] - r["since"] <= 8 for r in spans)
    taken = Counter()
    for r in spans:
        taken[(r["doc_id"], r["row"])] += r["until"] - r["since"]
    assert {(r["doc_id"], r["row"]): r["taken"] for r in got if r["taken"]} == taken
    again = M.taken_words(*M.mix(docs.repartition(5), block=8)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert M.taken_words(*M.mix(docs.limit(0))).count() == 0


def test_small_sources_meet_their_targets(spark):
    sizes = {"a": 200_000, "b": 300, "c": 900, "d": 2100, "e": 4100, "f": 150_000, "g": 1, None: 5}
    rows = []
    for s, n in sizes.items():
        step = 5000 if n > 10_000 else 70
        rows += [(len(rows) + k, "w " * min(step, n - at), s) for k, at in enumerate(range(0, n, step))]
    order, listed = M.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    got, target = Counter(), {}
    for r in M.taken_words(order, listed).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        got[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert target == pytest.approx(brute_targets(sizes, (3, 1, 2)))
    assert all(abs(got[s] - target[s]) <= 0.5 for s in sizes)
    # and so does each half of the schedule, by half
    spans = order.collect()
    half, some = max(r["slot"] for r in spans) / 2, Counter()
    for r in spans:
        some[r["source"]] += (r["until"] - r["since"]) * (r["slot"] <= half)
    assert all(abs(some[s] - target[s] / 2) <= max(4 * M.BLOCK * (target[s] > 32 * M.BLOCK), 0.15 * target[s] + 1) for s in sizes)


def test_whole_documents_keep_long_ones_and_targets(spark):
    docs = [(k, "w " * (40 + k % 9), s, k) for s in "abaaa" for k in range(300)]
    docs += [(1000 + k, "w " * (4000 + 300 * k), s, k) for s in "abaaa" for k in range(16)] + [(2000, "", "b", 0), (2001, None, "b", 0)]
    docs += [(3000, "w " * 50, "a", k) for k in range(9)] * 2
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, source string, extra int")
    listed = M.mix(docs, (20, 1))[1].collect()
    size, target = Counter(), {r["source"]: r["target"] for r in listed}
    for r in listed:
        size[r["source"]] += r["size"]
    assert target["b"] < 0.5 * size["b"]
    out = M.repeated_documents(docs, (20, 1))
    assert out.columns == docs.columns
    got, times = Counter(), Counter()
    for r in out.collect():
        got[r["source"]] += len((r["text"] or "").split())
        times[(r["source"], r["doc_id"])] += 1
    for s in "ab":
        assert abs(got[s] - target[s]) <= 8500
        long = sum(times[(s, 1000 + k)] for k in range(16))
        assert abs(long / (16 if s == "b" else 64) - target[s] / size[s]) < 0.1
    assert times[("b", 2000)] == times[("b", 2001)] == 1 and 9 <= times[("a", 3000)] <= 36


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_each_source_meets_its_target(spark, sf):
    taken, target = Counter(), {}
    sources = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "source")
    for r in M.op6_mixing(spark, f"/root/testdata/{sf}").join(sources, "doc_id").collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(target) > 2 and all(abs(taken[s] - t) <= max(1, 0.02 * t) for s, t in target.items())
