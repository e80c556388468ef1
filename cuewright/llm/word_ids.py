"""Token ids of whole texts under the word-end BPE tokenizer, each distinct part tokenized once.

The tokenizer drops white space, and neither its normaliser nor its pre-tokeniser looks across a
space or line feed, so the ids of a text are those of its space-separated parts in order. Texts are
cut and their parts numbered in Arrow; only parts that a bounded cache lacks reach the tokenizer,
parts of one pre-token many at a time; the parts' ids are then laid out by one gather.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np

#: A letter or digit, then trailing punctuation: pre-tokens always end between the two.
TAIL = r"([0-9a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([.,!%#$&*;:]+) "
#: Texts with these are cut at spaces only: special tokens, and marks that compose with the letter before them.
DELICATE = r"<\||\p{M}"
#: Characters handled at a time, parts tokenized in one string, and parts a cache generation holds.
PORTION, JOINED, CACHED = 8_000_000, 500, 400_000


class PartIds:
    """part -> its ids as little-endian unsigned 32-bit integers, kept for two generations of parts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        # a run of letters is one pre-token, so its ids end where a word does
        alone = [p for p in parts if not p.isalpha()]
        together = [p for p in parts if p.isalpha()]
        runs = [together[at : at + JOINED] for at in range(0, len(together), JOINED)]
        for run, ids in zip(runs, self._encoded([" ".join(run) for run in runs]), strict=True):
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(run):  # letters that the normaliser takes apart
                alone += run
                continue
            data, at = ids.tobytes(), 0
            for part, stop in zip(run, stops.tolist(), strict=True):
                yield part, data[at:stop]
                at = stop
        for at in range(0, len(alone), 10_000):
            some = alone[at : at + 10_000]
            yield from zip(some, (ids.tobytes() for ids in self._encoded(some)), strict=True)

    def of(self, parts: list[str]) -> list[bytes]:
        """Of distinct parts, in their order."""
        found = list(map(self.young.get, parts))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        fresh = {}
        missing = []
        for i in lacking:
            ids = self.old.get(parts[i])
            if ids is None:
                missing.append(parts[i])
            else:
                fresh[parts[i]] = ids
        fresh.update(self._learn(missing))
        for i in lacking:
            found[i] = fresh[parts[i]]
        if len(self.young) + len(fresh) > CACHED:
            self.old, self.young = self.young, {}
        if len(fresh) <= CACHED:
            self.young.update(fresh)
        return found


@cache
def part_ids(path: str) -> PartIds:
    return PartIds(path)


def vocabulary(path: str) -> int:
    """How many ids the tokenizer has; all are below."""
    return part_ids(path).size


def _portions(texts) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows of about PORTION characters."""
    import pyarrow.compute as pc

    reach, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        done = int(reach[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(reach, done + PORTION, "right")))
        yield at, stop
        at = stop


def _some(texts, path: str) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = pc.replace_substring(texts, "\n", " ")
    cut = pc.replace_substring_regex(pc.ascii_lower(raw), TAIL, r"\1 \2 ")
    parts = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, DELICATE), raw, cut), " ")
    numbered = parts.flatten().dictionary_encode()
    ids = part_ids(path).of(numbered.dictionary.to_pylist())
    which = numbered.indices.to_numpy()
    flat = np.frombuffer(b"".join(ids), "<u4")
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begins = np.cumsum(sizes) - sizes
    wide = sizes[which]
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(wide, out=ends[1:])
    out = flat[np.repeat(begins[which] - ends[:-1], wide) + np.arange(ends[-1])]
    offsets = parts.offsets.to_numpy().astype(np.int64)
    assert isinstance(parts, pa.ListArray)
    return ends[offsets - offsets[0]], out


def encode_array(texts, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, ids) of runs of rows of an Arrow string array: row first + i has ids[bounds[i]:bounds[i + 1]].

    Nulls are empty.
    """
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    for at, stop in _portions(texts):
        yield at, *_some(texts.slice(at, stop - at), path)


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    import pyarrow as pa

    return [ids[bounds[i] : bounds[i + 1]].tobytes() for _, bounds, ids in encode_array(pa.array(texts, pa.string()), path) for i in range(len(bounds) - 1)]
