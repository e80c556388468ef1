"""Finds cropped or edited copies of images by local descriptors.

Each grey image gives up to CORNERS corners in each cell of about CELL pixels a side, over several
scales, with an orientation from the intensity centroid; 256 brightness comparisons turned by it form
a descriptor. The comparisons are picked from a pool, on textures drawn from a seed, so that their bits are even
and say different things; without that a key of many bits holds little, and everything meets everything.

Descriptors are indexed in TABLES Hamming tables of KEY_BITS bits each, again chosen apart. A query's
descriptors look their keys up, also with the PROBES least certain bits turned over; hits on an image
vote by the turn between the two corners, and images of which VOTES corners of a query agree on
a turn are candidates. The corner pairs of a candidate must agree on one similarity transform (geometric consensus).

An image's payload is decoded and described where its row lies, once: only keys and row numbers are
shuffled, and descriptors where candidates need them. Images of equal pixels are one class with one index entry, so
that no group of copies multiplies. A query's own class is found by the hash of its pixels, whatever corners it has.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written

CORNERS, CELL, SCALES = 32, 96, (1.0, 0.75, 0.5625)
TABLES, KEY_BITS, PROBES, VOTES, INLIERS = 8, 24, 2, 2, 8
NEAR, TOLERANCE, PARTNERS = 60, 4.0, 64
RADIUS, TESTS, TURNS = 12, 256, 32
_disc = np.array([(x, y) for x in range(-7, 8) for y in range(-7, 8) if x * x + y * y <= 49])
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Layout(NamedTuple):
    """ends: (TURNS, TESTS, 2, xy) places compared around a corner; tables: (TABLES, KEY_BITS) tests of each key."""

    ends: np.ndarray
    tables: np.ndarray


def pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def parse_pgm(data: bytes) -> np.ndarray:
    head, rest = data.split(b"\n", 1)
    kind, width, height, most = head.split()
    if kind != b"P5" or most != b"255" or len(rest) != int(width) * int(height):
        raise ValueError("not an 8-bit binary PGM image")
    return np.frombuffer(rest, np.uint8).reshape(int(height), int(width))


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, over the last two axes."""
    h, w = image.shape[-2:]
    y = ((np.arange(height) + 0.5) * h / height - 0.5).clip(0, h - 1)
    x = ((np.arange(width) + 0.5) * w / width - 0.5).clip(0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], x - x0
    top = image[..., y0[:, None], x0] * (1 - fx) + image[..., y0[:, None], x1] * fx
    low = image[..., y1[:, None], x0] * (1 - fx) + image[..., y1[:, None], x1] * fx
    return top * (1 - fy) + low * fy


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2 r + 1, edges repeated, of a float32 array's last two axes."""
    for axis in (-1, -2):
        pad, n = [(0, 0)] * a.ndim, a.shape[axis]
        pad[axis] = (r, r)
        wide = np.moveaxis(np.pad(a, pad, mode="edge"), axis, 0)
        total = wide[:n].copy()
        for k in range(1, 2 * r + 1):
            total += wide[k : k + n]
        total *= np.float32(1 / (2 * r + 1))
        a = np.moveaxis(total, 0, axis)
    return a


def _corners(stack: np.ndarray, most: int) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Smoothed levels of a stack, and rows (image, level, y, x on the level, y, x on the image) of its strongest corners."""
    (_, h, w), margin = stack.shape, RADIUS + 1
    base, levels, rows = stack.astype(np.float32), [], [np.zeros((0, 7))]
    for at, scale in enumerate(SCALES):
        sh, sw = round(h * scale), round(w * scale)
        if min(sh, sw) < 2 * margin + 2:
            levels.append(None)
            continue
        level = _box(resized(base, sh, sw).astype(np.float32) if scale != 1 else base, 1)
        levels.append(level)
        gy, gx = np.gradient(level, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        least = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
        inner = least[:, margin : sh - margin, margin : sw - margin]
        peak = inner > 1e-3
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= inner >= least[:, margin + dy : sh - margin + dy, margin + dx : sw - margin + dx]
        i, y, x = np.nonzero(peak)
        rows.append(np.column_stack([i, np.full(len(i), at), y + margin, x + margin, (y + margin + 0.5) / scale, (x + margin + 0.5) / scale, inner[i, y, x]]))
    found = np.concatenate(rows)
    down, across = max(1, round(h / CELL)), max(1, round(w / CELL))
    cell = (found[:, 0] * down + found[:, 4] * down // h) * across + found[:, 5] * across // w
    order = np.lexsort((found[:, 1], found[:, 3], found[:, 2], -found[:, 6], cell))
    found, cell = found[order], cell[order]
    begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
    rank = np.arange(len(cell)) - np.repeat(begins, np.diff(np.r_[begins, len(cell)]))
    return levels, found[rank < most]


def _differences(levels: list, rows: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners, tests) differences of the compared places, and the corners' angles."""
    out, angles = np.zeros((len(rows), ends.shape[1]), np.float32), np.zeros(len(rows))
    for at, level in enumerate(levels):
        mine = np.flatnonzero(rows[:, 1] == at)
        if not len(mine):
            continue
        i, y, x = (rows[mine, c].astype(np.int64) for c in (0, 2, 3))
        around = level[i[:, None], y[:, None] + _disc[:, 1], x[:, None] + _disc[:, 0]]
        around = around - around.mean(1, keepdims=True)
        angles[mine] = np.arctan2(around @ _disc[:, 1], around @ _disc[:, 0])
        turned = ends[np.rint(angles[mine] / (2 * np.pi / TURNS)).astype(int) % TURNS]
        values = level[i[:, None, None], y[:, None, None] + turned[..., 1], x[:, None, None] + turned[..., 0]]
        out[mine] = values[..., 0] - values[..., 1]
    return out, angles


def _apart(likeness: np.ndarray, order: np.ndarray, count: int, allowed: float = 0.1) -> list[int]:
    """The first of order that are alike by less than allowed with all before, which is raised until there are count."""
    chosen: list[int] = []
    worst = np.zeros(len(likeness))
    while len(chosen) < count:
        for k in order.tolist():
            if len(chosen) < count and worst[k] < allowed:
                chosen.append(k)
                worst = np.maximum(worst, likeness[k])
        allowed += 0.05
    return chosen


@cache
def layout(seed: int = 9, pool: int = 1500) -> Layout:
    """Tests and keys whose bits are even and little correlated over the corners of textures drawn from the seed."""
    rng = np.random.default_rng(seed)
    radius, angle = RADIUS * np.sqrt(rng.random((pool, 2))), 2 * np.pi * rng.random((pool, 2))
    places = np.stack([radius * np.cos(angle), radius * np.sin(angle)], -1)
    turn = np.arange(TURNS) * (2 * np.pi / TURNS)
    x, y, c, s = places[..., 0], places[..., 1], np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    ends = np.rint(np.stack([x * c - y * s, x * s + y * c], -1)).astype(np.int64)
    drawn = np.stack([sum(resized(rng.normal(0, size, (n, n)), 128, 128) for n, size in ((4, 1.0), (8, 0.8), (16, 0.7), (32, 0.6), (64, 0.4))) for _ in range(40)])
    bits = (_differences(*_corners(128 + 45 * drawn, 60), ends)[0] < 0).astype(np.float32)
    uneven = np.abs(bits.mean(0) - 0.5)
    spread = bits.std(0)
    spread[spread == 0] = np.inf
    scaled = (bits - bits.mean(0)) / spread
    likeness = np.abs(scaled.T @ scaled) / len(bits)
    np.fill_diagonal(likeness, np.inf)  # each at most once
    order = np.argsort(uneven, kind="stable")
    kept = np.array(_apart(likeness, order[uneven[order] < 0.15], TESTS))
    among = likeness[np.ix_(kept, kept)]
    tables = np.array([_apart(among, rng.permutation(TESTS), KEY_BITS) for _ in range(TABLES)])
    return Layout(ends[:, kept], tables)


class Described(NamedTuple):
    """points: (x, y, scale, angle) of each corner; bits: its 32 bytes; sure: (corners, TESTS) how far each test was from turning over."""

    points: np.ndarray
    bits: np.ndarray
    sure: np.ndarray


NOTHING = Described(np.zeros((0, 4)), np.zeros((0, TESTS // 8), np.uint8), np.zeros((0, TESTS), np.float32))


def describe(stack: np.ndarray, plan: Layout | None = None) -> list[Described]:
    """The corners of each image of a stack of equal sizes."""
    plan = plan or layout()
    levels, rows = _corners(stack, CORNERS)
    differences, angles = _differences(levels, rows, plan.ends)
    bits = np.packbits(differences < 0, axis=1)
    points = np.column_stack([rows[:, 5], rows[:, 4], 1 / np.array(SCALES)[rows[:, 1].astype(int)], angles])
    bounds = np.searchsorted(rows[:, 0], np.arange(len(stack) + 1))
    return [Described(points[a:b], bits[a:b], np.abs(differences[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


#: An entry is key << 32 | corner << 8 | angle in 256ths of a turn; the key holds its table's number.
def entries(found: Described, plan: Layout, probes: int = 0) -> np.ndarray:
    """The entries of an image's corners in all tables; with 2^probes keys each, the least certain bits turned over."""
    plain = np.unpackbits(found.bits, axis=1)[:, plan.tables].astype(np.int64)  # corner, table, bit
    keys = (plain << np.arange(KEY_BITS)).sum(2)[:, :, None]
    if probes:
        unsure = np.int64(1) << np.argsort(found.sure[:, plan.tables], axis=2, kind="stable")[:, :, :probes].astype(np.int64)
        for k in range(probes):
            keys = np.concatenate([keys, keys ^ unsure[:, :, k : k + 1]], axis=2)
    keys = keys + (np.arange(TABLES, dtype=np.int64) << KEY_BITS)[:, None]
    angle = np.floor(found.points[:, 3] / (2 * np.pi) * 256).astype(np.int64) % 256
    corner = np.arange(len(found.points), dtype=np.int64) << 8 | angle
    return (keys << 32 | corner[:, None, None]).ravel()


def consensus(a: tuple, b: tuple) -> tuple[int, float, float, float, float]:
    """(inliers, scale, angle, dx, dy) of the best similarity transform from a's corners to b's; each: (points, bits, ...).

    Corner pairs are mutual nearest descriptors within NEAR bits. Two of them propose the transform of their
    positions if the orientations allow it (each with PARTNERS others, evenly spread, or with all if there are no
    more), and all vote; the winner is fitted again to its voters.
    """
    (pa, da), (pb, db) = a[:2], b[:2]
    if not len(pa) or not len(pb):
        return 0, 1.0, 0.0, 0.0, 0.0
    step = max(1, 4_000_000 // (32 * len(db)))
    distance = np.concatenate([_POPCOUNT[da[at : at + step, None, :] ^ db[None, :, :]].sum(2, dtype=np.int16) for at in range(0, len(da), step)])
    to, back = distance.argmin(1), distance.argmin(0)
    ia = np.flatnonzero((distance[np.arange(len(da)), to] <= NEAR) & (back[to] == np.arange(len(da))))
    if not len(ia):
        return 0, 1.0, 0.0, 0.0, 0.0
    ib, n = to[ia], len(ia)
    za, zb = pa[ia, 0] + 1j * pa[ia, 1], pb[ib, 0] + 1j * pb[ib, 1]
    twist = np.exp(1j * (pa[ia, 3] - pb[ib, 3]))
    strides = np.unique(np.linspace(1, n - 1, min(PARTNERS, n - 1)).astype(int)) if n > 1 else np.zeros(0, int)
    best, mask = 0, None
    for stride in strides:
        j = (np.arange(n) + stride) % n
        gap = za[j] - za
        far = np.flatnonzero(np.abs(gap) >= 8)
        factor = (zb[j] - zb)[far] / gap[far]
        fits = (np.abs(factor) > 0.4) & (np.abs(factor) < 2.5)
        fits[fits] = np.abs(np.angle(factor[fits] * twist[far][fits])) <= 0.5
        far, factor = far[fits], factor[fits]
        if len(far):
            near = np.abs(factor[:, None] * (za[None, :] - za[far, None]) + zb[far, None] - zb[None, :]) < TOLERANCE
            votes = near.sum(1)
            top = int(votes.argmax())
            if votes[top] > best:
                best, mask = int(votes[top]), near[top]
    if mask is None:
        return 1, 1.0, 0.0, 0.0, 0.0
    x, y = za[mask], zb[mask]
    mx, my = x.mean(), y.mean()
    spread = (np.abs(x - mx) ** 2).sum()
    factor = (np.conj(x - mx) * (y - my)).sum() / spread if spread > 0 else 1.0 + 0j
    shift = my - factor * mx
    return best, float(abs(factor)), float(np.angle(factor)), float(shift.real), float(shift.imag)


# ---- Spark --------------------------------------------------------------------------------------

Decode = Callable[[int, object], "np.ndarray | None"]
FOUND = "id bigint, r bigint, h binary, n int, points binary, bits binary, entries array<bigint>"


def decoded(_: int, payload: bytes | None) -> np.ndarray | None:
    return parse_pgm(payload) if payload else None


def described(images: DataFrame, decode: Decode, probes: int = 0) -> DataFrame:
    """(id, r, h, n, points, bits, entries) from (id, image): r numbers the row, h hashes its pixels, n counts its corners.

    Rows without an id or an image are left out; an image is what decode makes of the payload.
    """
    plan = layout()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        names = ["id", "r", "h", "n", "points", "bits", "entries"]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                images = {k: image for k, (key, data) in enumerate(zip(*(c.to_pylist() for c in some.columns), strict=True)) if (image := decode(key, data)) is not None}
                ids, found, shapes = some.column(0).to_pylist(), {}, {}
                for k, image in images.items():
                    shapes.setdefault(image.shape, []).append(k)
                for rows in shapes.values():
                    found |= dict(zip(rows, describe(np.stack([images[k] for k in rows]), plan) if min(images[rows[0]].shape) else [NOTHING] * len(rows), strict=True))
                numbers = np.frombuffer(os.urandom(8 * len(found)), "<i8")
                rows = [
                    (ids[k], r, hashlib.sha256(pgm(images[k])).digest(), len(f.points), f.points.astype("<f4").tobytes(), f.bits.tobytes(), entries(f, plan, probes))
                    for (k, f), r in zip(sorted(found.items()), numbers.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array([row[c] for row in rows], kind) for c, kind in enumerate(kinds)], names=names)

    rows = images.where("id IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "image")
    return rows.mapInArrow(run, FOUND)


def find_copies(images: DataFrame, queries: DataFrame, votes: int = VOTES, inliers: int = INLIERS, decode: Decode = decoded, decode_query: Decode = decoded) -> DataFrame:
    """(query_id, match_id, copies, inliers, scale, angle, dx, dy) of each copy found.

    images, queries: (id, image), the image as decode reads it (a binary PGM unless said otherwise). match_id is the
    least id of the images with the match's pixels and
    copies their number; scale, angle and shift map the query onto it. Equal pixels match with the
    unchanged transform and all their corners as inliers, even if these are none. Null ids and images match
    nothing; repeated rows count as copies; queries of equal id are one query, of the least pixel hash; other columns are
    left out; empty tables give empty results.
    """
    index = written(described(images, decode), "image-index")
    # one row of each class of equal pixels: its least id
    classes = written(index.groupBy("h").agg(F.min(F.struct("id", "r")).alias("one"), F.count("*").alias("copies")).select("h", "one.id", "one.r", "copies"), "image-classes")
    asked = written(described(queries, decode_query, PROBES), "image-queries")
    probe = asked.join(asked.groupBy("id").agg(F.min(F.struct("h", "r")).alias("one")).select("one.r"), "r", "left_semi").withColumnRenamed("id", "query_id")
    equal = probe.select("query_id", "h", F.col("n").alias("inliers")).join(classes, "h").select("query_id", "r", "inliers")

    table = index.select("r", "entries").join(classes.select("r"), "r", "left_semi").select("r", F.explode("entries").alias("e"))
    looked = probe.select("query_id", F.explode("entries").alias("q"))
    hits = looked.join(table, F.shiftright("q", 32) == F.shiftright("e", 32))
    turn = (F.col("e").bitwiseAND(255) - F.col("q").bitwiseAND(255) + 256) % 256  # of 256; 16 bins and 16 between them
    bins = F.array(F.floor(turn / 16), 16 + F.floor((turn + 8) % 256 / 16))
    corner = F.shiftright("q", 8).bitwiseAND((1 << 24) - 1)
    # a pair of images has boundedly many hits: by pair they make one exchange for all three counts
    agreeing = hits.select("query_id", "r", corner.alias("corner"), F.explode(bins).alias("bin")).repartition("query_id", "r").distinct()
    chosen = agreeing.groupBy("query_id", "r", "bin").count().where(F.col("count") >= votes).select("query_id", "r").distinct()
    candidates = written(chosen.join(equal, ["query_id", "r"], "left_anti"), "image-candidates")
    left = probe.select("query_id", F.col("points").alias("qp"), F.col("bits").alias("qb"))
    right = index.select("r", F.col("points").alias("mp"), F.col("bits").alias("mb"))
    paired = candidates.join(left, "query_id").join(right, "r").select("query_id", "r", "qp", "qb", "mp", "mb")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        opened = lambda p, b: (np.frombuffer(p, "<f4").reshape(-1, 4).astype(np.float64), np.frombuffer(b, np.uint8).reshape(-1, TESTS // 8))
        for batch in batches:
            rows = []
            for q, m, qp, qb, mp, mb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((q, m, *consensus(opened(qp, qb), opened(mp, mb))))
            names = ["query_id", "r", "inliers", "scale", "angle", "dx", "dy"]
            kinds = [pa.int64()] * 3 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    agreed = paired.mapInArrow(run, "query_id bigint, r bigint, inliers bigint, scale double, angle double, dx double, dy double")
    one, zero = F.lit(1.0), F.lit(0.0)
    same = equal.select("query_id", "r", F.col("inliers").cast("bigint"), one.alias("scale"), zero.alias("angle"), zero.alias("dx"), zero.alias("dy"))
    named = classes.select("r", F.col("id").alias("match_id"), "copies")
    return agreed.where(F.col("inliers") >= inliers).unionByName(same).join(named, "r").select("query_id", "match_id", "copies", "inliers", "scale", "angle", "dx", "dy")


# ---- the query's images -------------------------------------------------------------------------

SIDE = 96


def picture(vector: list[float]) -> np.ndarray:
    """A texture drawn from a vector: equal vectors give equal pixels."""
    from zlib import crc32

    rng = np.random.default_rng(crc32(np.array(vector, "<f4").tobytes()))
    field = sum(resized(rng.normal(0, a, (n, n)), SIDE, SIDE) for n, a in ((8, 1.0), (16, 0.8), (30, 0.5)))
    return (128 + 45 * field).clip(0, 255).astype(np.uint8)


def edited(image: np.ndarray, kind: int) -> np.ndarray:
    """0: crop; 1: crop with other contrast; 2: quarter turn, brighter; 3: smaller, noisy."""
    h, w = image.shape
    if kind == 0:
        return image[h // 8 :, w // 6 :]
    if kind == 1:
        return (image[: h - h // 6, w // 10 : w - w // 10] * 0.7 + 20).astype(np.uint8)
    if kind == 2:
        return np.minimum(np.rot90(image).astype(int) + 25, 255).astype(np.uint8)
    small = resized(image.astype(float), round(h * 0.8), round(w * 0.8))
    return (small + np.random.default_rng(1).normal(0, 3, small.shape)).clip(0, 255).astype(np.uint8)


def picture_of(_: int, vector: list[float] | None) -> np.ndarray | None:
    return None if vector is None else picture(vector)


def edited_picture_of(key: int, vector: list[float] | None) -> np.ndarray | None:
    """The vector's picture, edited by id."""
    return None if vector is None else edited(picture(vector), key // 100 % 4)


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited pictures of the vectors with ids divisible by 100, searched among the pictures of all.

    The tables hold no images, so they are drawn from vectors, where they are described.
    """
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("image"))
    # drawing and describing cost far more than moving a vector: a small file is spread over all tasks first
    vectors = vectors.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return find_copies(vectors, vectors.where("id % 100 = 0"), decode=picture_of, decode_query=edited_picture_of)


QUERIES = {"op3_image_copies": op3_image_copies}
ORACLE: dict[str, str] = {}
