import itertools

import numpy as np
from cuewright.llm import line_quality as L
from pyspark.sql import functions as F


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    sizes = np.array([3, 1, 5, 2])
    score, transition = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    p, z, expected = L.forward_backward(score, sizes, transition)
    at, pairs = 0, np.zeros((2, 2))
    for c, n in enumerate(sizes):
        weights = {}
        for path in itertools.product((0, 1), repeat=n):
            weights[path] = sum(score[at + i] * y for i, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:]))
        total = sum(map(np.exp, weights.values()))
        assert np.isclose(z[c], np.log(total))
        for i in range(n):
            assert np.isclose(p[at + i], sum(np.exp(w) for path, w in weights.items() if path[i]) / total)
        for path, w in weights.items():
            for a, b in zip(path, path[1:]):
                pairs[a, b] += np.exp(w) / total
        at += n
    assert np.allclose(pairs, expected)


def test_features_see_lines_and_neighbours():
    x, size, n = L.line_features(["ab AB\nab AB\nx!!", "", "é"])
    assert x.shape == (5, L.FEATURES) and n.tolist() == [3, 1, 1] and size.tolist() == [5, 5, 3, 0, 2]
    own = x[:, : L.OWN]
    assert np.allclose(x[1, L.OWN : 2 * L.OWN], own[0]) and np.allclose(x[1, 2 * L.OWN : 3 * L.OWN], own[2])
    assert (x[3, L.OWN : 3 * L.OWN] == 0).all() and x[3, -3] == x[3, -2] == 1
    assert own[1, L.CLASSES + 6] == 1 and own[0, L.CLASSES + 6] == 0  # said before


def test_learns_and_scores(spark):
    good, bad = "The plain words of a text.\nAnother line of it.", "AAA!! BBB!! CCC!!\nzz zz zz zz zz"
    rows = [(i, good if i % 2 else bad, "q") for i in range(60)] + [(60, None, "q"), (61, "", "q"), (None, bad, "q"), (7, good, "q"), (62, good * 400, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    field = L.train(docs, labels, F.lit(True), sample=40)
    got = L.line_quality(docs, field).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert all((by[i] > 0.5) == bool(i % 2) for i in range(60)) and by[62] > 0.5 and by[60] == by[61]
    again = L.train(docs.repartition(3), labels, F.lit(True), sample=40)
    assert (again.weight == field.weight).all()
    twice = L.train(docs, labels.unionByName(labels.where("doc_id < 9").withColumn("quality", F.lit(1))), F.lit(True), sample=40)
    assert (twice.weight == field.weight).all()  # of several labels the lowest counts
    nothing = L.train(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in L.line_quality(docs, nothing).collect()} == {0.5}
    assert L.line_quality(docs.limit(0), field).count() == 0
