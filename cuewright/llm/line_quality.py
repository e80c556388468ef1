"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are byte-class shares, lengths and repetitions of the line
itself and of its two neighbours; a transition score ties consecutive labels. A document's quality
is the length-weighted mean of its lines' forward-backward marginals of "good".

Labels exist for documents only, so in training every line of a document carries its label. The
model is fitted on a bounded sample of labelled documents (SAMPLE, those of least hash) by gradient
ascent of the conditional log-likelihood; every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SAMPLE, STEPS, RATE, L2 = 6000, 150, 0.05, 1e-4
#: Lines of one training chain; longer documents of the sample are several chains.
CHAIN = 64

_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".", b",;:", b"!", b"?", b"|", b"%", b"#", b"$", b"&", b"*", b"()[]{}<>", b"'\"`", b"/\\_=+~^", b"-", b"@")
_HIGH, _OTHER = len(_GROUPS), len(_GROUPS) + 1
CLASSES = len(_GROUPS) + 2
_CLASS = np.full(256, _OTHER, np.uint8)
for _i, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _i
_CLASS[128:] = _HIGH
OWN = CLASSES + 11
FEATURES = 3 * OWN + 3


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, bytes of every line, lines of every text); an empty text is one empty line."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    joined = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    n_lines = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
    n = len(size)
    line = np.repeat(np.arange(n, dtype=np.int64), size + 1)
    hist = np.bincount(line * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float32)
    hist[:, _OTHER] -= 1  # the line feed
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (data[1:] != 32)
    doubled = np.bincount(line[same], minlength=n)
    gap = (data == 32) | (data == 9)
    head = np.zeros(len(data), bool)
    head[0], head[1:] = True, data[:-1] == 10
    opens = ~gap & (data != 10) & (head | np.concatenate([[True], gap[:-1]]))
    words = np.bincount(line[opens], minlength=n)
    upper = _CLASS[data] == 1
    capital = np.bincount(line[opens & upper], minlength=n)
    # a word that ends in other than a letter, digit, dot or comma
    closes = ~gap & (data != 10) & np.concatenate([gap[1:] | (data[1:] == 10), [True]])
    odd = np.bincount(line[closes & (_CLASS[data] > 5) & (_CLASS[data] != _HIGH)], minlength=n)
    repetition = _repetition(joined, starts, ends, n_lines)
    per = 1 / np.maximum(size, 1)
    own = np.empty((n, OWN), np.float32)
    own[:, :CLASSES] = hist * per[:, None]
    own[:, CLASSES:] = np.column_stack(
        [np.log1p(size), np.log1p(words), words * per, doubled * per, capital / np.maximum(words, 1), odd / np.maximum(words, 1), *repetition]
    )
    first = np.zeros(n, bool)
    first[np.cumsum(n_lines) - n_lines] = True
    last = np.append(first[1:], True) if n else first
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:], behind[:-1] = own[:-1], own[1:]
    before[first], behind[last] = 0, 0
    return np.column_stack([own, before, behind, first, last, np.ones(n)]).astype(np.float32), size, n_lines


def _repetition(joined: bytes, starts: np.ndarray, ends: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Of each line: whether the text had it before, the share of its words that are new in the text,
    that are new in the line, that equal the word before, and whether most do."""
    found = np.zeros((5, len(starts)), np.float32)
    found[1:3] = 1
    at = 0
    for count in n_lines.tolist():
        lines, words = set(), set()
        for i in range(at, at + count):
            content = joined[starts[i] : ends[i]]
            if not content:
                continue
            if content in lines:
                found[0, i] = 1
            lines.add(content)
            if parts := content.split():
                before = len(words)
                words.update(parts)
                found[1, i] = (len(words) - before) / len(parts)
                found[2, i] = len(set(parts)) / len(parts)
                found[3, i] = sum(map(eq, parts, parts[1:])) / len(parts)
        at += count
    found[4] = found[3] > 0.3
    return found


@dataclass
class LineField:
    """Weights of "good" against "bad", transition[a, b] from label a to b, and feature scales."""

    weight: np.ndarray
    transition: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def emission(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale).clip(-8, 8) @ self.weight

    def marginals(self, x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """P(good) of every line, by forward-backward within its document."""
        return forward_backward(self.emission(x), n_lines, self.transition)[0]


def forward_backward(score: np.ndarray, n_lines: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, log partition of each chain, expected transitions summed).

    score: of "good" against "bad". All chains advance together; the longest come first, so that the
    live ones are a prefix.
    """
    order = np.argsort(-n_lines, kind="stable")
    begin = (np.cumsum(n_lines) - n_lines)[order]
    length = n_lines[order]
    longest = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(longest), side="left")  # chains longer than t
    gap = np.zeros(len(score))  # log alpha(good) - log alpha(bad)
    base = np.zeros(len(score))  # log alpha(bad)
    (t00, t01), (t10, t11) = transition
    log = np.logaddexp
    for t in range(longest):
        at = begin[: live[t]] + t
        if t == 0:
            gap[at] = score[at]
            continue
        bad, good = base[at - 1], base[at - 1] + gap[at - 1]
        to_bad, to_good = log(bad + t00, good + t10), log(bad + t01, good + t11) + score[at]
        base[at], gap[at] = to_bad, to_good - to_bad
    ends = begin + length - 1
    partition = np.zeros(len(length))
    partition[order] = log(base[ends], base[ends] + gap[ends])
    beta_bad, beta_good = np.zeros(len(score)), np.zeros(len(score))
    expected = np.zeros((2, 2))
    total = partition[order]
    for t in range(longest - 1, 0, -1):
        at = begin[: live[t]] + t
        z = total[: live[t]]
        bad, good = base[at - 1] - z, base[at - 1] + gap[at - 1] - z
        next_bad, next_good = beta_bad[at], beta_good[at] + score[at]
        expected += [
            [np.exp(bad + t00 + next_bad).sum(), np.exp(bad + t01 + next_good).sum()],
            [np.exp(good + t10 + next_bad).sum(), np.exp(good + t11 + next_good).sum()],
        ]
        beta_bad[at - 1] = log(t00 + next_bad, t01 + next_good)
        beta_good[at - 1] = log(t10 + next_bad, t11 + next_good)
    odds = gap + beta_good - beta_bad
    return 1 / (1 + np.exp(-odds.clip(-60, 60))), partition, expected


def fit(x: np.ndarray, n_lines: np.ndarray, label: np.ndarray) -> LineField:
    """Maximum conditional likelihood by Adam; label: 0 or 1 of each document. Without rows all scores are ½."""
    if len(label) == 0:
        return LineField(np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros(x.shape[1]), np.ones(x.shape[1]))
    pieces = [[min(CHAIN, n - k) for k in range(0, n, CHAIN)] for n in n_lines.tolist()]
    chains = np.array([p for ps in pieces for p in ps], np.int64)
    good = np.repeat(np.repeat(label, [len(ps) for ps in pieces]), chains).astype(np.float64)
    mean, deviation = x.mean(0), x.std(0)
    field = LineField(np.zeros(x.shape[1]), np.zeros((2, 2)), mean * (deviation > 0), np.where(deviation > 1e-6, 1 / np.maximum(deviation, 1e-6), 1))
    scaled = ((x - field.mean) * field.scale).clip(-8, 8)
    pairs = chains - 1
    chain_good = np.repeat(label, [len(ps) for ps in pieces])
    observed = np.array([[pairs[chain_good == 0].sum(), 0], [0, pairs[chain_good == 1].sum()]], float)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weight, transition = theta[:-4], theta[-4:].reshape(2, 2)
        p, _, expected = forward_backward(scaled @ weight, chains, transition)
        gradient = np.concatenate([scaled.T @ (good - p) / len(p) - L2 * weight, ((observed - expected) / len(p)).ravel() - 1e-2 * theta[-4:]])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field.weight, field.transition = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def score_texts(texts: list[str], field: LineField) -> np.ndarray:
    """Length-weighted mean of the lines' P(good), each line counting one more than its bytes."""
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) < 1_500_000):
            held += len(texts[end])
            end += 1
        x, size, n_lines = line_features(texts[at:end])
        p, w = field.marginals(x, n_lines), size + 1.0
        starts = np.cumsum(n_lines) - n_lines
        out[at:end] = np.add.reduceat(p * w, starts) / np.add.reduceat(w, starts)
        at = end
    return out.clip(0, 1)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> LineField:
    """Fits on at most ``sample`` labelled documents for which learn holds, those of least id hash.

    Null labels and ids don't count; of several labels of one id the lowest does. Features, not texts, come to the driver.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & learn)
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(F.col("quality").cast("int")).alias("q"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for key, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, _, n = line_features([text])
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([label], pa.int32()), pa.array([x.astype("<f4").tobytes()])], names=["id", "q", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    found = rows.join(F.broadcast(chosen), "id").select(F.col("id").cast("bigint"), "q", "t").mapInArrow(run, "id bigint, q int, x binary").collect()
    found.sort(key=lambda r: (r["id"], r["q"], bytes(r["x"])))
    x = [np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES) for r in found]
    n_lines = np.array([len(m) for m in x], np.int64)
    return fit(np.concatenate(x) if x else np.zeros((0, FEATURES), np.float32), n_lines, np.array([r["q"] for r in found], np.float64))


def line_quality(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row from its text alone; null texts are empty; repeated rows are each scored."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            scores = score_texts(batch.column(1).to_pylist(), field)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def passing(docs: DataFrame, field: LineField, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least so much."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            scores = score_texts([t or "" for t in batch.column(place).to_pylist()], field)
            yield batch.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    field = train(docs, labels, ~held_out())
    return line_quality(docs, field).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op10_line_quality": op10_line_quality}
ORACLE: dict[str, str] = {}
