import numpy as np
import pytest
from cuewright.llm import image_copies as I


def drawn(n, seed):
    rng = np.random.default_rng(seed)
    return [I.picture(v) for v in rng.normal(size=(n, 64)).astype("f4")]


def test_pgm():
    image = drawn(1, 0)[0][:40, :50]
    assert (I.parse_pgm(I.pgm(image)) == image).all()
    with pytest.raises(ValueError):
        I.parse_pgm(b"P5 3 3 255\nab")


def test_consensus_finds_the_transform():
    image = drawn(1, 1)[0]
    base, turned = I.describe(image[None])[0], I.describe(np.ascontiguousarray(np.rot90(image))[None])[0]
    n, scale, angle, dx, dy = I.consensus(turned, base)
    assert n >= 15 and abs(scale - 1) < 0.05 and abs(angle - np.pi / 2) < 0.05 and abs(dx - 96) < 3 and abs(dy) < 3
    assert I.consensus(base, I.describe(drawn(1, 2)[0][None])[0])[0] < I.INLIERS
    nothing = np.zeros((0, 4)), np.zeros((0, 32), np.uint8)
    assert I.consensus(base, nothing)[0] == 0 and I.consensus(nothing, base)[0] == 0
    assert len(I.describe(np.full((1, 96, 96), 9, np.uint8))[0][0]) == 0 and len(I.describe(np.zeros((1, 5, 5), np.uint8))[0][0]) == 0


def test_search_equals_brute_force(spark):
    images = drawn(24, 3)
    rows = [(i, I.pgm(x), 1) for i, x in enumerate(images)] + [(100 + i, I.pgm(images[4]), 1) for i in range(5)] + [(200, None, 1), (None, I.pgm(images[5]), 1), (4, I.pgm(images[4]), 1), (300, I.pgm(images[6][:20, :20]), 1)]
    table = spark.createDataFrame(rows, "id bigint, image binary, copies int")
    asked = [(1000 + i, I.pgm(I.edited(images[i], i % 4))) for i in range(0, 24, 2)] + [(1, None), (None, I.pgm(images[0])), (2, I.pgm(drawn(1, 77)[0]))]
    queries = spark.createDataFrame(asked, "id bigint, image binary")
    got = I.find_copies(table, queries).collect()
    found = {(r["query_id"], r["match_id"]): r["copies"] for r in got}
    assert len(found) == len(got)
    features = [I.describe(x[None])[0] for x in images]
    want = set()
    for q, data in asked:
        if q is not None and data is not None:
            own = I.describe(I.parse_pgm(data)[None])[0]
            want |= {(q, i) for i in range(24) if I.consensus(own, features[i])[0] >= I.INLIERS}
    assert {(1000 + i, i) for i in range(0, 24, 2)} <= want
    assert set(found) <= want and len(found) >= 0.9 * len(want)
    assert found[(1004, 4)] == 7 and found[(1000, 0)] == 1
    assert I.find_copies(table.limit(0), queries).count() == 0 and I.find_copies(table, queries.limit(0)).count() == 0


def test_equal_pixels_need_no_corners(spark):
    small, flat, full = drawn(1, 5)[0][:20, :20], np.full((96, 96), 7, np.uint8), drawn(1, 6)[0]
    rows = [(1, I.pgm(small)), (2, I.pgm(small)), (3, I.pgm(flat)), (4, I.pgm(full)), (5, I.pgm(drawn(1, 7)[0]))]
    table = spark.createDataFrame(rows, "id bigint, image binary")
    asked = spark.createDataFrame([(11, I.pgm(small)), (12, I.pgm(flat)), (13, I.pgm(full)), (14, I.pgm(small[:, :19]))], "id bigint, image binary")
    got = I.find_copies(table, asked).collect()
    assert sorted((r["query_id"], r["match_id"], r["copies"]) for r in got) == [(11, 1, 2), (12, 3, 1), (13, 4, 1)]
    assert all((r["scale"], r["angle"], r["dx"], r["dy"]) == (1, 0, 0, 0) for r in got)
    assert {r["query_id"]: r["inliers"] for r in got} == {11: 0, 12: 0, 13: 32}


def test_corners_grow_with_the_image():
    rng = np.random.default_rng(8)
    field = sum(I.resized(rng.normal(0, a, (n, n)), 384, 384) for n, a in ((32, 1.0), (64, 0.8), (120, 0.5)))
    image = (128 + np.linspace(8, 45, 384) * field).clip(0, 255).astype(np.uint8)  # weak at the left
    whole = I.describe(image[None])[0]
    assert len(whole[0]) == 16 * I.CORNERS
    found = [I.consensus(I.describe(image[None, y : y + 120, x : x + 120])[0], whole)[0] for y in range(0, 260, 60) for x in range(0, 260, 60)]
    assert sum(n >= I.INLIERS for n in found) >= 23  # of 25


def voted(queries, images, plan):
    """(query, image) pairs of which VOTES corners agree on a turn, as the tables are read by the search."""
    table, agreeing = {}, {}
    for i, found in enumerate(images):
        for e in I.entries(found, plan).tolist():
            table.setdefault(e >> 32, []).append((i, e & 255))
    for q, found in enumerate(queries):
        for e in I.entries(found, plan, I.PROBES).tolist():
            for i, angle in table.get(e >> 32, ()):
                turn = (angle - (e & 255)) % 256
                for k in (turn // 16, 16 + (turn + 8) % 256 // 16):
                    agreeing.setdefault((q, i, k), set()).add(e >> 8 & 0xFFFFFF)
    return {(q, i) for (q, i, _), corners in agreeing.items() if len(corners) >= I.VOTES}


def test_tables_select():
    plan, images = I.layout(), drawn(120, 11)
    features = [f for at in range(0, 120, 60) for f in I.describe(np.stack(images[at : at + 60]), plan)]
    asked = [I.describe(np.ascontiguousarray(I.edited(images[k], k % 4))[None], plan)[0] for k in range(40)]
    pairs = voted(asked, features, plan)
    assert {(k, k) for k in range(40)} <= pairs and len(pairs) - 40 <= 0.01 * 40 * 119
