"""Bounded-space online best-fit packing of documents into sequences of a fixed number of tokens.

Items arrive one by one; open bins hang on a bitset whose bit f says that some bin has f places
free. An item goes to the open bin with the least free space that holds it, which is the lowest set
bit at or above its length. At most ``bins`` are open: if a new one is needed beyond that, the fullest closes.
A full bin closes by itself. Items come in random order through a buffer of ``ahead``, which hands over its
longest first. Only lengths are packed, so a task holds a few numbers a bin and the rows of one buffer.

The bound costs little: over sf0.1 (11,336 pieces) 4,541 sequences come out, over 3 files of check_s (24,371)
11,664, where all lengths together would fill 4,539 and 11,661.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_ids
from .common import read, written

#: Open bins of a task, rows in its buffer, and how many pieces it gets on average.
BINS, AHEAD, ITEMS = 1024, 2000, 30_000


class BestFit:
    """place(length) -> (bin number, offset in it)."""

    def __init__(self, size: int, bins: int = BINS):
        self.size, self.most = size, bins
        self.bits, self.open, self.made, self.closed = 0, 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(size + 1)]

    def _hang(self, number: int, free: int) -> None:
        if free:
            self.free[free].append(number)
            self.bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        number = self.free[free].pop()
        if not self.free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            number, free = self.made, self.size
            self.made += 1
        self._hang(number, free - length)
        return number, self.size - free


def pieces(docs: DataFrame, path: str, end_id: int, size: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, row) of each document, cut only if longer than size."""
    kind = dict(docs.dtypes)[id_col]
    tail = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, bounds, ids in word_ids.encode_array(batch.column(1), path):
                keys, cuts = [], []
                for row, (low, high) in enumerate(itertools.pairwise(bounds.tolist()), first):
                    data = ids[low:high].tobytes() + end
                    for k in range(0, len(data), 4 * size):
                        keys.append(row)
                        cuts.append((k // (4 * size), k // 4, data[k : k + 4 * size]))
                arrays = [
                    batch.column(0).take(pa.array(keys, pa.int64())),
                    pa.array([c[0] for c in cuts], pa.int32()),
                    pa.array([c[1] for c in cuts], pa.int64()),
                    pa.array([len(c[2]) // 4 for c in cuts], pa.int64()),
                    pa.array([zlib.crc32(c[2]) for c in cuts], pa.int64()),
                ] + ([pa.array([np.frombuffer(c[2], "<i4") for c in cuts], pa.list_(pa.int32()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{tail}")


def packer(size: int, bins: int, ahead: int):
    """Places the rows of a task as they come, ``ahead`` of them at a time and of those the longest first."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        fit, base, held = BestFit(size, bins), TaskContext.get().partitionId() << 32, []

        def placed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            lengths = rows.column("length").to_numpy()
            places = np.zeros((len(lengths), 2), np.int64)
            for at in np.argsort(-lengths, kind="stable").tolist():
                places[at] = fit.place(int(lengths[at]))
            rows = rows.append_column("sequence_id", pa.array(base + places[:, 0])).append_column("offset", pa.array(places[:, 1]))
            yield from rows.combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            while len(rows) >= ahead:
                yield from placed(rows.slice(0, ahead))
                rows = rows.slice(ahead)
            held = rows.to_batches()
        if held:
            yield from placed(pa.Table.from_batches(held))

    return run


def best_fit(docs: DataFrame, path: str, end_id: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, with_ids: bool = False, ahead: int = AHEAD) -> DataFrame:
    """Places every document's ids, the end id last, into sequences of at most size.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset) and, if asked for, ids.
    Null texts are empty and give the end id alone; repeated rows and equal or null ids are placed
    each on its own; other columns are left out; an empty table gives an empty result.
    Pieces are dealt and ordered by a hash of what they are, so that a task run again places them alike.
    """
    cut = written(pieces(docs, path, end_id, size, id_col, text_col, with_ids), "pieces")
    tasks = max(1, -(-cut.count() // ITEMS))  # each leaves some bins part full: few of them, however many cores there are
    spread = F.pmod(F.xxhash64("id", "piece", "length", "ids_crc32"), F.lit(1 << 30))
    dealt = cut.repartition(tasks, spread).sortWithinPartitions(F.xxhash64("ids_crc32", "piece", "id"), "id", "piece", "ids_crc32", "length")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    return dealt.mapInArrow(packer(size, bins, ahead), schema).withColumnRenamed("id", id_col)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_packing": op8_packing}
ORACLE: dict[str, str] = {}
