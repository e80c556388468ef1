"""Language-model scores from a hierarchical Pitman-Yor model sampled by Gibbs.

Tokens are words and one end a text. A token's context is the token before it, the end for the
first. Contexts have Chinese restaurants: one for every word that comes before another, however many there are
(or, unless `whole` is asked for, as many as contexts_for() gives, each for the words of one hash). All restaurants share one parent, whose
base splits UNKNOWN for the unseen and the rest evenly over the seen words:

    p(w | a) = (c_aw - d1 t_aw) / (q1 + C_a) + (q1 + d1 T_a) / (q1 + C_a) · p(w)
    p(w)     = (c_w - d0 t_w) / (q0 + C_0) + (q0 + d0 T_0) / (q0 + C_0) · base(w),   c_w = sum of t_aw over a

where tables t are the customers of the parent. Gibbs sampling redraws the tables of one dish in one
restaurant from their conditional, proportional to S_d(c, t) · ((q + d T) · p_parent)^t with generalised
Stirling numbers S_d, in turn for all dishes and both levels; discounts come from counts of counts.
Predictive probabilities are averaged over the kept sweeps.

Texts are turned into blocks: per block the distinct (word, context) pairs and, per token, its pair's number,
which stay in files of the shared folder. A pair's counts go to the bucket of its word's hash, which reads its range of each
block's file; so all tables of a word meet in one bucket, which samples them given totals of the restaurants, and sends each
block the log-probabilities of just its pairs. A word's entries are summed in its block first, so a bucket gets one entry for
each pair and block however frequent the word is.

The totals, two numbers for each context, are gathered by a first pass: a bucket sends what it knows of the contexts of its
pairs to shards, ranges of the contexts' hashes, and gets back their sums. Neither a task nor the driver meets all contexts.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, read, read_file, store, write_file, written

UNKNOWN = 0.9
#: How many context restaurants there are at least and at most where words share them.
CONTEXTS = 1 << 8, 1 << 18
STRENGTH = (1.0, 1.0)
BURN_IN, KEPT = 2, 4
#: Characters of a block, and of the text whose pairs a bucket gets on average.
BLOCK_CHARS, BUCKET_CHARS = 12_000_000, 8_000_000
#: Buckets for each shard of the contexts' totals, whose size so stays the same.
SHARD_BUCKETS = 8
#: Counts up to which tables are drawn from their exact conditional.
EXACT = 256
END = b" "  # no word has white space


def squeezed(values: np.ndarray) -> bytes:
    """Compressed byte by byte of the numbers: first bytes first, and so on."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def opened(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeezed_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, as their steps."""
    return squeezed(np.diff(keys.astype("<u8"), prepend=np.uint64(0)))


def opened_keys(data: bytes) -> np.ndarray:
    return np.cumsum(opened(data, "<u8"), dtype=np.uint64)


def words_of(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split()


# ---- restaurants --------------------------------------------------------------------------------


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S[c, t]: weighted ways to seat c customers at t tables; S[c + 1, t] = S[c, t - 1] + (c - d t) S[c, t]."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore"):
        for c in range(most):
            s[c + 1] = np.log((c - discount * t).clip(0)) + s[c]
            s[c + 1, 1:] = np.logaddexp(s[c + 1, 1:], s[c, :-1])
    return s


def draw_tables(count: np.ndarray, weight: np.ndarray, discount: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with count customers, weight = (q + d T) · p_parent.

    Up to EXACT customers from the conditional; the customers beyond come in growing groups, each
    opening tables with the chance weight / (weight + seated - d t) at its start.
    """
    out = np.minimum(count, 1).astype(np.int64)
    first = np.minimum(count, EXACT)
    order = np.argsort(first, kind="stable")
    values, starts = np.unique(first[order], return_index=True)
    for c, low, high in zip(values.tolist(), starts, [*starts[1:], len(order)]):
        if c < 2:
            continue
        step = max(1, 3_000_000 // c)
        for at in range(low, high, step):
            rows = order[at : min(at + step, high)]
            t = np.arange(1, c + 1)
            log = table[c, 1 : c + 1] + t * np.log(weight[rows, None].clip(1e-300))
            p = np.exp(log - log.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[rows] = 1 + (p < rng.random(len(rows))[:, None] * p[:, -1:]).sum(axis=1).clip(0, c - 1)
    many = np.flatnonzero(count > EXACT)
    seated = np.full(len(many), EXACT, np.int64)
    while len(many):
        group = np.minimum(count[many] - seated, seated // 4)
        chance = weight[many] / (weight[many] + seated - discount * out[many])
        out[many] += rng.binomial(group, chance.clip(0, 1))
        seated += group
        left = seated < count[many]
        many, seated = many[left], seated[left]
    return out


def discount_of(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


@dataclass
class Totals:
    """Of all buckets: customers and tables of each context (or, of many contexts together), of the parent, words, and discounts."""

    customers: np.ndarray
    tables: np.ndarray
    parent_customers: float
    parent_tables: float
    words: float
    d0: float
    d1: float

    def base(self) -> float:
        return (1 - UNKNOWN) / max(self.words, 1)

    def back_off(self) -> np.ndarray:
        return (STRENGTH[1] + self.d1 * self.tables) / (STRENGTH[1] + self.customers)

    def new_word(self) -> float:
        """What the parent leaves to its base."""
        return (STRENGTH[0] + self.d0 * self.parent_tables) / (STRENGTH[0] + self.parent_customers)


class Restaurants:
    """The restaurants' parts that hold the words of one bucket; sampled given totals."""

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int, contexts: int, seed: int):
        """One entry for each dish of a context restaurant: word number, context, customers (over 0)."""
        self.word, self.context, self.count, self.n, self.contexts = word, context, count, n_words, contexts
        self.rng = np.random.default_rng(seed)
        self.tables = np.ones(len(word), np.int64)
        self.seat_parent()
        self.parent_tables = np.minimum(self.parent, 1)

    def seat_parent(self) -> None:
        self.parent = np.bincount(self.word, self.tables, self.n).astype(np.int64)

    def parent_p(self, t: Totals) -> np.ndarray:
        own = (self.parent - t.d0 * self.parent_tables) / (STRENGTH[0] + t.parent_customers)
        return own + t.new_word() * t.base()

    def tables_beyond(self, scale: float) -> np.ndarray:
        """Tables of each dish's context, as far as a bucket of so many can tell: the dish's own, and scale times those of
        the context's other dishes here. So a context all of whose tables are here counts them once."""
        here = np.bincount(self.context, self.tables, self.contexts)[self.context]
        return self.tables + scale * (here - self.tables)

    def sweep(self, t: Totals, s0: np.ndarray, s1: np.ndarray, tables: np.ndarray | None = None) -> None:
        """Redraws all tables, given totals; tables: those of each dish's context, where t doesn't know them."""
        weight = (STRENGTH[1] + t.d1 * (t.tables[self.context] if tables is None else tables)) * self.parent_p(t)[self.word]
        self.tables = draw_tables(self.count, weight, t.d1, s1, self.rng)
        self.seat_parent()
        weight = np.full(self.n, (STRENGTH[0] + t.d0 * t.parent_tables) * t.base())
        self.parent_tables = draw_tables(self.parent, weight, t.d0, s0, self.rng)

    def totals(self, scale: float = 1.0) -> Totals:
        """Totals as far as seen here, times scale."""
        d1 = discount_of((self.count == 1).sum(), (self.count == 2).sum())
        d0 = discount_of((self.parent == 1).sum(), (self.parent == 2).sum())
        customers, tables = (scale * np.bincount(self.context, x, self.contexts) for x in (self.count, self.tables))
        return Totals(customers, tables, scale * self.parent.sum(), scale * self.parent_tables.sum(), scale * self.n, d0, d1)


# ---- blocks and buckets -------------------------------------------------------------------------


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def contexts_for(chars: int) -> int:
    """How many context restaurants for so many characters of text, where words share them: a power of two, twice their root at least."""
    least, most = CONTEXTS
    return min(most, max(least, 1 << math.isqrt(4 * chars).bit_length()))


def before_of(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each in its text; number 0, the end, comes before the first."""
    before = np.concatenate([[0], numbers[:-1]])
    before[np.cumsum(sizes) - sizes] = 0
    return before


def contexts_of(numbers: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, contexts: int) -> np.ndarray:
    """The shared restaurant of each token: by the hash of the token before it."""
    return (hashes[before_of(numbers, sizes)] >> np.uint64(32)).astype(np.int64) % contexts  # other bits than those of buckets


BLOCKS = "block string, bucket int, data binary, ids array<bigint>, held array<boolean>, sizes array<int>"


def blocks(rows: DataFrame, contexts: int | None, buckets: int) -> DataFrame:
    """Rows of two kinds: a block (bucket -1, with the path of its file: the pair number of each token) and its request
    to each bucket (data: where in the block's file of pairs their word hashes, contexts and training counts are).

    contexts: how many restaurants words share, None for one a word.
    """
    folder = new_folder(rows.sparkSession, "block-tokens")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema(
            [("block", pa.string()), ("bucket", pa.int32()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32()))]
        )
        numbers, tokens, ids, held, chars = None, [], [], [], 0

        def close():
            data, requests = pairs_of(list(numbers), tokens, held, contexts, buckets)
            path = f"{folder}/{uuid.uuid4().hex}"  # this attempt's own
            write_file(path, data)
            write_file(f"{path}-pairs", b"".join(d for _, d in requests))
            at = np.cumsum([0, *(len(d) for _, d in requests)]).tolist()
            requests = [(b, struct.pack("<2Q", start, len(d))) for (b, d), start in zip(requests, at)]
            row = {"block": path, "bucket": -1, "data": None, "ids": ids, "held": held, "sizes": [len(t) for t in tokens]}
            yield pa.RecordBatch.from_pylist([row], schema)
            yield pa.RecordBatch.from_pylist([{"block": path, "bucket": b, "data": d, "ids": None, "held": None, "sizes": None} for b, d in requests], schema)

        for batch in batches:
            for key, text, out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if numbers is None:
                    numbers = _Numbers({END: 0})
                found = words_of(text)
                found.append(END)
                tokens.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                ids.append(key)
                held.append(out)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield from close()
                    numbers, tokens, ids, held, chars = None, [], [], [], 0
        if ids:
            yield from close()

    return rows.mapInArrow(run, BLOCKS)


def pairs_of(words: list[bytes], tokens: list[np.ndarray], held: list[bool], contexts: int | None, buckets: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    from xxhash import xxh3_64_intdigest

    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    sizes = np.array([len(t) for t in tokens], np.int64)
    number = np.concatenate(tokens)
    by_hash = np.argsort(hashes)
    rank_of = np.empty(len(words), np.int64)
    rank_of[by_hash] = np.arange(len(words))
    if contexts is None:
        context, keys = rank_of[before_of(number, sizes)], hashes[by_hash]
    else:  # as keys over the whole range, for shards
        context, keys = contexts_of(number, sizes, hashes, contexts), np.arange(contexts, dtype=np.uint64) * np.uint64((1 << 64) // contexts)
    number, hashes = rank_of[number], hashes[by_hash]
    pair, token = np.unique(number * len(keys) + context, return_inverse=True)
    train = np.repeat(~np.array(held, bool), sizes)
    count = np.bincount(token[train], minlength=len(pair))
    word = pair // len(keys)
    bucket = (hashes[word] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    requests = []
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
    for low, high in zip(edges[:-1], edges[1:]):
        rows = order[low:high]
        w, per = np.unique(word[rows], return_counts=True)
        c, place = np.unique(pair[rows] % len(keys), return_inverse=True)
        parts = [squeezed_keys(hashes[w]), squeezed_keys(keys[c]), *(squeezed(p.astype("<u4")) for p in (per, place, count[rows]))]
        requests.append((int(bucket[rows[0]]), struct.pack("<5I", *map(len, parts)) + b"".join(parts)))
    return squeezed(rank[token].astype("<u4")), requests


def read_requests(table) -> Iterator[bytes]:
    """A bucket's range of each block's file of pairs; the files of a run lie in one folder."""
    filesystem, folder = store(table.column("block")[0].as_py().rpartition("/")[0])
    for block, data in zip(table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True):
        start, size = struct.unpack("<2Q", data)
        with filesystem.open_input_file(f"{folder}/{block.rpartition('/')[2]}-pairs") as source:
            yield source.read_at(size, start)


def _opened(data: bytes) -> tuple[np.ndarray, ...]:
    """(hashes of words, keys of contexts, how many pairs each word has, and of each pair: its context's place, count)."""
    parts, at = [], 20
    for size in struct.unpack_from("<5I", data):
        parts.append(data[at : at + size])
        at += size
    return *map(opened_keys, parts[:2]), *(opened(p, "<u4").astype(np.int64) for p in parts[2:])


def _gathered(table) -> tuple[Restaurants, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Of a bucket's requests: (restaurants, and of each requested pair: its number, then of each number: word, context,
    whether it is in training texts; pairs of each request, keys of the contexts in ascending order)."""
    parts = [_opened(data) for data in read_requests(table)]
    hashes, keys, per, place, count = (np.concatenate([o[k] for o in parts]) for k in range(5))
    word = np.repeat(np.unique(hashes, return_inverse=True)[1], per)
    keys, own = np.unique(keys, return_inverse=True)
    sizes = [len(o[4]) for o in parts]
    starts = np.cumsum([0, *(len(o[1]) for o in parts[:-1])])
    pair, number = np.unique(word * len(keys) + own[place + np.repeat(starts, sizes)], return_inverse=True)
    total = np.bincount(number, count, len(pair)).astype(np.int64)
    seen = total > 0
    words, dense = np.unique(pair[seen] // len(keys), return_inverse=True)
    rest = Restaurants(dense, pair[seen] % len(keys), total[seen], len(words), len(keys), table.column("bucket")[0].as_py())
    lookup = np.full(int(pair[-1] // len(keys)) + 1, -1, np.int64)
    lookup[words] = np.arange(len(words))
    return rest, number, lookup[pair // len(keys)], pair % len(keys), seen, sizes, keys


def dealt(rows: DataFrame, key: str, groups: int):
    """Rows grouped by a key, in about as many tasks as there are groups, so that a task's share stays the same at every size."""
    return rows.repartition(groups, key).groupBy(key)


def context_totals(requests: DataFrame, buckets: int) -> DataFrame:
    """Of a first sampling pass: (shard, bucket, customers, KEPT times tables) of the contexts that a bucket asks for, in
    ascending order of their keys; and for each shard a row of sums (bucket -1), with those of the words in the first one's."""
    shards = -(-buckets // SHARD_BUCKETS)

    def sample(table):
        import pyarrow as pa

        rest, *_, keys = _gathered(table)
        tables, parent, parent_tables = np.zeros(len(keys)), 0.0, 0.0
        for k in range(BURN_IN + KEPT):
            t = rest.totals(buckets)
            rest.sweep(t, stirling(t.d0), stirling(t.d1), rest.tables_beyond(buckets))
            if k >= BURN_IN:
                tables += np.bincount(rest.context, rest.tables, len(keys))
                parent += rest.parent.sum() / KEPT
                parent_tables += rest.parent_tables.sum() / KEPT
        ones = [float((x == n).sum()) for x in (rest.parent, rest.count) for n in (1, 2)]
        sums = [float(rest.count.sum()), float(rest.n), parent, parent_tables, *ones]
        known = [x.astype("<i8") for x in (np.bincount(rest.context, rest.count, len(keys)), tables)]
        edges, bucket = np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1)), table.column("bucket")[0]
        rows = [
            (n, bucket.as_py(), squeezed_keys(keys[i:j]), *(squeezed(x[i:j]) for x in known), None if n else sums)
            for n, (i, j) in enumerate(zip(edges[:-1], edges[1:]))
            if j > i or n == 0
        ]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()))
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["shard", "bucket", "keys", "customers", "tables", "sums"])

    def add(table):
        import pyarrow as pa

        keys = [opened_keys(k) for k in table.column("keys").to_pylist()]
        _, own = np.unique(np.concatenate(keys), return_inverse=True)
        edges, sent, sums = np.cumsum([0, *map(len, keys)]), [], []
        for name in ("customers", "tables"):
            values = np.bincount(own, np.concatenate([opened(d, "<i8") for d in table.column(name).to_pylist()])).astype("<i8")
            sums.append(float(values.sum()))
            sent.append([*(squeezed(values[own[i:j]]) for i, j in zip(edges[:-1], edges[1:])), None])
        known = [x for x in table.column("sums").to_pylist() if x]
        sums += np.sum(known, axis=0).tolist() if known else []
        columns = [table.column("shard").to_pylist()[:1] * len(sent[0]), [*table.column("bucket").to_pylist(), -1], *sent, [None] * len(keys) + [sums]]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64()))
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["shard", "bucket", "customers", "tables", "sums"])

    sampled = dealt(requests, "bucket", buckets).applyInArrow(sample, "shard int, bucket int, keys binary, customers binary, tables binary, sums array<double>")
    return written(dealt(sampled, "shard", shards).applyInArrow(add, "shard int, bucket int, customers binary, tables binary, sums array<double>"), "totals")


def totals_of(table: DataFrame) -> tuple[Totals, int, int]:
    """(totals, with contexts summed by shard; training tokens, training words) of context_totals()."""
    found = sorted((r["shard"], r["sums"]) for r in table.where("bucket = -1").select("shard", "sums").collect())
    customers, tables = (np.array([x[k] for _, x in found]) for k in range(2))
    tokens, words, parent, parent_tables, *ones = found[0][1][2:] if found else [0.0] * 8
    return Totals(customers, tables / KEPT, parent, parent_tables, words, discount_of(*ones[:2]), discount_of(*ones[2:])), int(tokens), int(words)


def gather_totals(requests: DataFrame, contexts: int | None, buckets: int) -> tuple[Totals, int, int]:
    """(totals, training tokens, training words) by a first sampling pass in every bucket; whatever the contexts are."""
    return totals_of(context_totals(requests, buckets))


def answers(requests: DataFrame, contexts: DataFrame, totals: Totals, buckets: int) -> DataFrame:
    """(block, bucket, p, c): for each pair of a request its averaged log10 probability and its word's training count."""

    def run(table, known_contexts):
        import pyarrow as pa

        rest, number, word, context, seen, sizes, _ = _gathered(table)
        order = pa.array(np.argsort(known_contexts.column("shard").to_numpy(), kind="stable"))
        customers, tables = (np.concatenate([opened(d, "<i8") for d in known_contexts.column(name).take(order).to_pylist()]) for name in ("customers", "tables"))
        t = replace(totals, customers=customers, tables=tables / KEPT)
        s0, s1 = stirling(t.d0), stirling(t.d1)
        unseen = t.new_word() * UNKNOWN
        own, parent = np.zeros(len(rest.word)), np.zeros(rest.n)
        for k in range(BURN_IN + KEPT):
            rest.sweep(t, s0, s1)
            if k >= BURN_IN:
                own += (rest.count - t.d1 * rest.tables) / KEPT
                parent += rest.parent_p(t) / KEPT
        known = word >= 0
        p = np.full(len(word), unseen)
        p[known] = parent[word[known]]
        p *= t.back_off()[context]
        p[seen] += own / (STRENGTH[1] + t.customers[context[seen]])
        per_word = np.bincount(rest.word, rest.count, rest.n)
        c = np.zeros(len(word), np.int64)
        c[known] = per_word[word[known]]
        log, c, at, out = np.log10(p)[number].astype("<f4"), c[number].astype("<u4"), 0, ([], [])
        for n in sizes:
            out[0].append(squeezed(log[at : at + n]))
            out[1].append(squeezed(c[at : at + n]))
            at += n
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "p": pa.array(out[0], pa.binary()), "c": pa.array(out[1], pa.binary())})

    asked = contexts.where("bucket >= 0").select("shard", "bucket", "customers", "tables")
    return dealt(requests, "bucket", buckets).cogroup(dealt(asked, "bucket", buckets)).applyInArrow(run, "block string, bucket int, p binary, c binary")


SCORES = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def sums_of(blocks_: DataFrame, answered: DataFrame, tokens: int, words: int) -> DataFrame:
    """Each document's sums over its tokens; a block and its answers meet in one task."""
    whole = float(tokens + words + 1)

    def run(block, answer):
        import pyarrow as pa

        order = np.argsort(answer.column("bucket").to_numpy(), kind="stable")
        p, c = (np.concatenate([opened(d, kind) for d in answer.column(name).take(pa.array(order)).to_pylist()]) for name, kind in (("p", "<f4"), ("c", "<u4")))
        p = p.astype(np.float64)
        token = opened(read_file(block.column("block")[0].as_py()), "<u4")
        sizes = np.array(block.column("sizes")[0].as_py(), np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        base = np.log10((c + 1.0) / whole)
        add = lambda values: np.bincount(owner, values[token], len(sizes))
        return pa.table(
            {
                "id": pa.array(block.column("ids")[0].as_py(), pa.int64()),
                "held_out": pa.array(block.column("held")[0].as_py(), pa.bool_()),
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(add((c > 0).astype(float)).astype(np.int64), pa.int64()),
                "base_score": pa.array(add(base), pa.float64()),
                "score": pa.array(add(p), pa.float64()),
            }
        )

    return blocks_.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, SCORES)


def language_scores(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    whole: every word has a restaurant of its own for what follows it; else words share contexts_for() of them.
    Learns from the rows for which held is false or null. Null texts are empty and have the end
    token alone; repeated rows each count and are each scored; other columns are left out; with no
    row to learn from every token is unknown; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("t"), F.coalesce(held, F.lit(False)).alias("held"))
    chars = rows.agg(F.sum(F.length("t").cast("bigint"))).first()[0] or 0
    buckets = max(4, -(-chars // BUCKET_CHARS))
    table = written(blocks(rows, None if whole else contexts_for(chars), buckets), "blocks")
    requests = table.where("bucket >= 0").select("bucket", "block", "data")
    contexts = context_totals(requests, buckets)
    totals, tokens, words = totals_of(contexts)
    scored = sums_of(table.where("bucket = -1").select("block", "ids", "held", "sizes"), answers(requests, contexts, totals, buckets), tokens, words)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return language_scores(read(spark, sf_dir, "documents"), held, whole=True)


QUERIES = {"op9_pitman_yor": op9_pitman_yor}
ORACLE: dict[str, str] = {}
