"""Token ids on disk: canonical length-limited Huffman codes from global counts, read by tables.

File layout (integers little-endian), one file for a run of documents in order:

    magic "CWH1", u32 header length, JSON header {first, docs, tokens, symbols, block, step, limit, keys, parts},
    code lengths as one byte a symbol (zlib), document token counts as u32 (zlib),
    then blocks: u32 tokens, u32 words, u32 checkpoints, the checkpoints' bit offsets as u32, words as u32.

A block holds up to BLOCK ids and decodes on its own; a checkpoint gives the bit offset of every
STEP-th id, from where decoding can start. Codes have at most ``limit`` bits (LIMIT, or as many as
the used ids need), so one table of 2^limit entries decodes any code.
"""

from __future__ import annotations

import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_ids
from .common import bucket_of, new_folder, order_buckets, read, read_file, splits, write_file, written

MAGIC, LIMIT, BLOCK, STEP = b"CWH1", 16, 1 << 16, 256
FILE_TOKENS = 8 << 20


# ---- codes --------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, at most limit, of least total length (package-merge); 0: unused.

    Ties go by symbol. Raises ValueError if more symbols are used than limit bits can name.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels: list[np.ndarray] = []  # of each level: whether its sorted items are leaves
    packages = np.zeros(0)
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        ranks = np.argsort(items, kind="stable")
        levels.append(ranks < len(leaves))
        items = items[ranks]
        packages = items[0 : len(items) // 2 * 2 : 2] + items[1 : len(items) // 2 * 2 : 2]
    take = 2 * len(leaves) - 2  # items chosen on the last level; their packages are chosen below
    for is_leaf in reversed(levels):
        n_leaves = int(is_leaf[:take].sum())
        lengths[order[:n_leaves]] += 1
        take = 2 * (take - n_leaves)
    return lengths


def limit_for(used: int) -> int:
    """The longest code of a file: LIMIT bits unless more ids are used than these can name."""
    return max(LIMIT, (max(used, 1) - 1).bit_length())


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        bits = lengths[order].astype(np.uint64)
        share = np.uint64(1) << (np.uint64(32) - bits)
        codes[order] = ((np.cumsum(share) - share) >> (np.uint64(32) - bits)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every value of the next limit bits (length 0: no such code)."""
    symbol, size = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    wide = np.left_shift(1, limit - lengths[order].astype(np.int64))
    filled = int(wide.sum())
    symbol[:filled], size[:filled] = np.repeat(order, wide), np.repeat(lengths[order], wide)
    return symbol, size


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> bytes:
    """One block."""
    bits = lengths[ids].astype(np.int64)
    at = np.cumsum(bits) - bits
    total = int(at[-1] + bits[-1])
    wide = codes[ids].astype(np.uint64) << (64 - bits - (at & 31)).astype(np.uint64)
    n_words = (total + 31) // 32
    word = at >> 5
    high = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n_words + 1)
    low = np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words + 2)[: n_words + 1]
    words = (high + low).astype(np.uint64).astype("<u4")[:n_words]  # bits don't overlap: sums are exact
    checkpoints = at[::step].astype("<u4")
    return struct.pack("<3I", len(ids), n_words, len(checkpoints)) + checkpoints.tobytes() + words.tobytes()


def unpack(block: memoryview, table: tuple[np.ndarray, np.ndarray], step: int = STEP, limit: int = LIMIT) -> tuple[np.ndarray, int]:
    """(ids, bytes read): all checkpoints of the block decode side by side."""
    n, n_words, n_checks = struct.unpack_from("<3I", block)
    at = np.frombuffer(block, "<u4", n_checks, 12).astype(np.int64)
    end = 12 + 4 * n_checks + 4 * n_words
    words = np.zeros(n_words + 2, np.uint64)
    words[:n_words] = np.frombuffer(block, "<u4", n_words, 12 + 4 * n_checks)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    symbol, size = table
    out = np.zeros((step, n_checks), np.uint32)
    last = n - step * (n_checks - 1)
    for k in range(min(step, n)):
        if k == last:  # the last run is shorter
            at = at[:-1]
        window = (pairs[at >> 5] >> (64 - limit - (at & 31)).astype(np.uint64)).astype(np.int64) & ((1 << limit) - 1)
        bits = size[window]
        if not bits.all():
            raise ValueError("a bit run that is no code")
        out[k, : len(at)] = symbol[window]
        at = at + bits
    return out.T.reshape(-1)[:n], end


# ---- files --------------------------------------------------------------------------------------


def write_run(first: int, docs: list[np.ndarray], keys: list, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    sizes = zlib.compress(np.array([len(d) for d in docs], "<u4").tobytes())
    code = zlib.compress(lengths.tobytes())
    header = json.dumps({"first": first, "docs": len(docs), "tokens": len(ids), "symbols": len(lengths), "limit": limit_for(int(np.count_nonzero(lengths))), "block": BLOCK, "step": STEP, "keys": keys, "parts": [len(code), len(sizes)]}).encode()
    blocks = [pack(ids[i : i + BLOCK], lengths, codes) for i in range(0, len(ids), BLOCK)]
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, code, sizes, *blocks])


def read_run(data: bytes) -> Iterator[tuple[object, int, np.ndarray]]:
    """(key, start, ids) of each document of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<I", data, 4)
    header, at = json.loads(data[8 : 8 + n]), 8 + n
    code, sizes = header["parts"]
    lengths = np.frombuffer(zlib.decompress(data[at : at + code]), np.uint8)
    counts = np.frombuffer(zlib.decompress(data[at + code : at + code + sizes]), "<u4").astype(np.int64)
    table, view, at, found = decode_table(lengths, header["limit"]), memoryview(data), at + code + sizes, []
    while at < len(data):
        ids, read_bytes = unpack(view[at:], table, header["step"], header["limit"])
        found.append(ids)
        at += read_bytes
    ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
    ends = np.cumsum(counts)
    for key, size, end in zip(header["keys"], counts.tolist(), ends.tolist(), strict=True):
        yield key, header["first"] + end - size, ids[end - size : end]


# ---- Spark --------------------------------------------------------------------------------------


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, ids) of each document where it lies: ids as bytes of u16, or of u32 if any id needs that."""
    kind = id_kind(path, end_id)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for first, bounds, ids in word_ids.encode_array(batch.column(1), path):
                small, sizes = ids.astype(kind), np.diff(bounds)
                data = [small[a:b].tobytes() + end for a, b in itertools.pairwise(bounds.tolist())]
                arrays = [batch.column(0).slice(first, len(sizes)), pa.array(sizes + 1, pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col)).mapInArrow(run, "id bigint, n bigint, ids binary")


def id_kind(path: str, end_id: int) -> str:
    return "<u2" if max(word_ids.vocabulary(path) - 1, end_id) < 1 << 16 else "<u4"


def symbol_counts(tokens: DataFrame, kind: str, symbols: int) -> np.ndarray:
    """Global counts of every id below symbols; at most one row an id comes back to the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(symbols, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=symbols)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(symbols, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_ids(tokens: DataFrame, kind: str, symbols: int, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes token files in ascending order of (id, ids), nulls first; the manifest has (path, first, docs, tokens).

    Only ids are shuffled, into runs of about equal counts of documents; a run's first place is the sum of the runs before.
    """
    spark = tokens.sparkSession
    folder = new_folder(spark, "ids")
    counts = symbol_counts(tokens, kind, symbols)
    lengths = code_lengths(counts, limit_for(int(np.count_nonzero(counts))))
    codes = canonical(lengths)
    most = order_buckets(spark)
    placed = tokens.withColumn("bucket", bucket_of(F.col("id"), splits(tokens, "id", most)))
    totals = {r["bucket"]: r["n"] for r in placed.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # bounded: buckets
    before, first = 0, {}
    for bucket in sorted(totals):
        first[bucket] = before
        before += totals[bucket]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        docs, keys, start, size, now, place = [], [], 0, 0, None, 0
        schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())])

        def close() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.cwh"
            write_file(path, write_run(start, docs, keys, lengths, codes))
            return pa.RecordBatch.from_pylist([{"path": path, "first": start, "docs": len(docs), "tokens": size}], schema)

        for batch in batches:
            for bucket, key, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    now, place = bucket, first[bucket]
                if docs and (place != start + size or size + n > file_tokens):  # not the next document, or full
                    yield close()
                    docs, keys, size = [], [], 0
                if not docs:
                    start = place
                docs.append(np.frombuffer(ids, kind))
                keys.append(key)
                size += n
                place += n
        if docs:
            yield close()

    dealt = placed.select("bucket", "id", "n", "ids").repartition(max(1, most // 4), "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("id"), "ids")
    return written(dealt.mapInArrow(run, "path string, first bigint, docs bigint, tokens bigint"), "ids-manifest")


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 and, if asked for, ids) of each document of the files."""
    tail = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(read_run(read_file(path)))
                arrays = [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([len(r[2]) for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], pa.int64()),
                ] + ([pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + tail)


def token_file_rows(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes the texts, writes the token files and reads them back.

    Null texts are empty and give the end id alone; rows of equal id follow each other by their ids; a
    null id comes first; other columns are left out; an empty table gives an empty result.
    """
    kind = id_kind(path, end_id)
    tokens = written(encoded(docs, path, end_id, id_col, text_col), "tokens")
    return read_ids(write_ids(tokens, kind, max(word_ids.vocabulary(path), end_id + 1), file_tokens), with_ids).withColumnRenamed("id", id_col)


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file_rows(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op4_token_file": op4_token_file}
ORACLE: dict[str, str] = {}
