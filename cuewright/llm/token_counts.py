"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie in flat numpy arrays with sequence starts (ragged arrays). In each round
every live sequence applies its own lowest-ranked pair, the leftmost at ties, all sequences at once;
sequences with no pair left leave the arrays with the count of their surviving symbols. Equal
pre-tokens are merged once a batch and kept in a bounded cache. A long sequence applies its lowest
pair in all places at once where that can't change the outcome, so its rounds are few.

Pieces never hold a word mark after another character, so the runs ``▁+[^▁]*`` merge on their own;
long runs are cut further where no piece holds the two neighbouring characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, portions, read

MARK = "▁"
BIG = np.int64(1) << 62


class PieceMerger:
    """The merge table of a piece model with byte fallback, and the merging itself."""

    def __init__(self, pieces: list[str], scores: list[float], mergeable: list[bool]):
        """pieces, their scores (higher merges first), and which are ordinary pieces."""
        known = {p: i for i, (p, m) in enumerate(zip(pieces, mergeable, strict=True)) if m}
        symbols = dict(known)
        for p in known:
            for ch in p:
                symbols.setdefault(ch, len(pieces) + len(symbols))
        self.width = max(symbols.values(), default=0) + 2
        self.chars = {s: i for s, i in symbols.items() if len(s) == 1}
        self.weight = np.ones(self.width, np.int64)
        for ch, i in self.chars.items():
            if ch not in known:
                self.weight[i] = len(ch.encode())
        rank = {s: r for r, s in enumerate(sorted({scores[i] for i in known.values()}, reverse=True))}
        rows = sorted(
            (symbols[p[:k]] * self.width + symbols[p[k:]], rank[scores[i]], i) for p, i in known.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols
        )
        self.keys, self.ranks, self.made = (np.array([r[c] for r in rows] or [-1], np.int64) for c in range(3))
        self.joined = {p[k : k + 2] for p in known for k in range(len(p) - 1)}
        self.of_char = np.full(0x110000, self.width - 1, np.int32)
        self.of_char[[ord(ch) for ch in self.chars]] = list(self.chars.values())
        # a merge is plain if what it makes can't pair at once into something of its own rank or before it
        own = np.full(self.width, -1, np.int64)
        own[self.made] = self.ranks
        self.plain = np.ones(self.width, bool)
        for side in (self.keys // self.width, self.keys % self.width):
            self.plain[side[self.ranks <= own[side]]] = False
        values, times = np.unique(own[own >= 0], return_counts=True)
        self.plain &= ~np.isin(own, values[times > 1])
        slot = self._slot(self.keys)
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        self.slots[slot] = np.arange(len(self.keys))
        taken, times = np.unique(slot, return_counts=True)
        self.slots[taken[times > 1]] = -2  # shared by several keys: found by binary search

    BITS = 22

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or BIG, index of the merge) of each neighbouring pair."""
        key = left * self.width + right
        at = self.slots[self._slot(key)]
        if (shared := at == -2).any():
            at[shared] = np.minimum(np.searchsorted(self.keys, key[shared]), len(self.keys) - 1)
        found = (at >= 0) & (self.keys[at] == key)
        return np.where(found, self.ranks[at], BIG >> 34), at

    @classmethod
    def load(cls, path: str) -> PieceMerger:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        ordinary = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in ids]
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], ordinary)

    def parts(self, run: str) -> list[str]:
        """A run cut where no piece can span the cut."""
        cuts = [i for i in range(1, len(run)) if run[i - 1 : i + 1] not in self.joined]
        return [run[a:b] for a, b in zip([0, *cuts], [*cuts, len(run)], strict=True)]

    def count(self, runs: list[str], long: int = 64) -> list[int]:
        """Surviving symbols of each run, characters unknown to the model counted by their bytes."""
        lengths = np.array([len(run) for run in runs], np.int64)
        if not (lengths > long).any():
            return self.merge(runs, lengths).tolist()
        split = [self.parts(run) if len(run) > long else [run] for run in runs]
        parts = [p for ps in split for p in ps]
        counts = self.merge(parts, np.array([len(p) for p in parts], np.int64))
        owner = np.repeat(np.arange(len(runs)), [len(ps) for ps in split])
        return np.bincount(owner, counts, len(runs)).astype(np.int64).tolist()

    def merge(self, parts: list[str], lengths: np.ndarray) -> np.ndarray:
        n, none = len(parts), self.width - 1
        points = np.frombuffer("".join(parts).encode("utf-32-le", errors="surrogatepass"), np.uint32)
        symbol, owner = self.of_char[points].astype(np.int64), np.repeat(np.arange(n), lengths)
        counts = np.zeros(n, np.int64)
        if (unknown := symbol == none).any():  # counted by bytes here, and as a symbol below
            p = points[unknown]
            counts += np.bincount(owner[unknown], (p > 0x7F).astype(np.int64) + (p > 0x7FF) + (p > 0xFFFF), n).astype(np.int64)
        rank, merge = np.full(len(symbol), BIG >> 34), np.zeros(len(symbol), np.int64)
        if len(symbol) > 1:
            rank[:-1], merge[:-1] = self.pairs(symbol[:-1], symbol[1:])
            rank[:-1][owner[:-1] != owner[1:]] = BIG >> 34
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.minimum.reduceat((rank << 34) | np.arange(len(symbol)), starts)
            live = low < BIG
            size = np.diff(np.append(starts, len(symbol)))
            keep = np.repeat(live, size)
            if not live.all():
                counts += np.bincount(owner[~keep], self.weight[symbol[~keep]], n).astype(np.int64)
                if not live.any():
                    break
            pick = low[live] & ((1 << 34) - 1)
            if size.max() > self.LONG:
                pick = self._all_of(pick, low, live, size, rank, merge)
            sequence = np.searchsorted(starts, pick, "right") - 1
            last = (starts + size)[sequence] - 1
            symbol[pick] = self.made[merge[pick]]
            keep[pick + 1] = False
            after = pick + 2
            inner = after <= last  # the new symbol has a right neighbour
            rank[pick] = BIG >> 34
            rank[pick[inner]], merge[pick[inner]] = self.pairs(symbol[pick[inner]], symbol[after[inner]])
            left = pick[pick > starts[sequence]]
            left = left[keep[left - 1]]  # else it is the right neighbour of a symbol just made
            rank[left - 1], merge[left - 1] = self.pairs(symbol[left - 1], symbol[left])
            symbol, owner, rank, merge = symbol[keep], owner[keep], rank[keep], merge[keep]
        return counts


    #: Longer sequences apply a plain merge in all its places in one round.
    LONG = 128

    def _all_of(self, pick: np.ndarray, low: np.ndarray, live: np.ndarray, size: np.ndarray, rank: np.ndarray, merge: np.ndarray) -> np.ndarray:
        """The picks, and where a sequence's is plain all places of its pair that don't overlap, from the left."""
        plain = np.zeros(len(low), bool)
        plain[live] = self.plain[self.made[merge[pick]]]
        place = np.flatnonzero((rank == np.repeat(low >> 34, size)) & np.repeat(plain, size))
        begins = np.flatnonzero(np.diff(place, prepend=-2) != 1)  # of runs of overlapping places
        nth = np.arange(len(place)) - np.repeat(begins, np.diff(np.append(begins, len(place))))
        return np.sort(np.concatenate([pick[~plain[live]], place[nth % 2 == 0]]))


_mergers: dict[str, tuple[PieceMerger, WordCache]] = {}


def _cache(path: str) -> WordCache:
    if path not in _mergers:
        merger = PieceMerger.load(path)
        _mergers[path] = merger, WordCache(lambda words: merger.count([MARK + w.replace(" ", MARK) for w in words]))
    return _mergers[path][1]


def words_of(text: str) -> list[str]:
    """What follows each word mark: further marks (as spaces) and the characters up to the next one."""
    if not text:
        return []
    found = text.replace(MARK, " ").split(" ")
    if "" not in found:
        return found
    out, held = [], ""
    for word in found[:-1]:
        if word:
            out.append(held + word)
            held = ""
        else:
            held += " "
    return [*out, held + found[-1]]


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text under the piece model at path."""
    cache, counts = _cache(path), [0] * len(texts)
    for run in portions(texts):
        split = [words_of(texts[i]) for i in run]
        cache.learn(set().union(*split))
        for i, words in zip(run, split, strict=True):
            counts[i] = sum(map(cache.__getitem__, words))
    return counts


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; map-only.

    Null and empty texts have no bytes and no tokens; repeated rows and equal ids are each kept;
    other columns, also of the result's names, are left out; an empty table gives an empty result.
    """

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sizes = picked.select("id", F.coalesce("t", F.lit("")).alias("t"))
    kind = dict(picked.dtypes)["id"]
    out = sizes.mapInArrow(_counter(path), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _counter(path: str):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.binary_length(texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())).cast(pa.int64())
            counts = count_tokens(texts.to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE: dict[str, str] = {}
