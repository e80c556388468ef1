import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from cuewright.llm import huffman as H
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("limit", [3, 4, 6, 16])
def test_lengths_are_optimal_and_limited(limit):
    rng = np.random.default_rng(limit)
    for n in (1, 2, 3, 5, 8):
        counts = rng.integers(1, 5000, n) ** 2
        got = H.code_lengths(counts, limit).astype(int)
        assert got.max() <= limit and sum(2.0**-b for b in got) <= 1
        if n > 1 and limit <= 4 and n <= 5:
            best = min((counts * np.array(c)).sum() for c in itertools.product(range(1, limit + 1), repeat=n) if sum(2.0**-b for b in c) <= 1)
            assert (counts * got).sum() == best
    with pytest.raises(ValueError):
        H.code_lengths(np.ones(9, np.int64), 3)


def test_unlimited_matches_huffman():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 200)
    heap, total = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert (H.code_lengths(counts, 16).astype(int) * counts).sum() == total


@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 40_000).astype(np.uint32)
    lengths = H.code_lengths(np.bincount(ids))
    block = H.pack(ids, lengths, H.canonical(lengths))
    back, used = H.unpack(memoryview(block), H.decode_table(lengths))
    assert used == len(block) and (back == ids).all()


def test_rows_equal_the_library(spark):
    texts = ["Hello World", None, "", "a\n\n b\tc  d's <|endoftext|> é é", "Straße ΣΑΣ 日本語" * 40, "x" * 3000, "same", "same"]
    docs = spark.createDataFrame([(i * 3 - 4, t, "z") for i, t in enumerate(texts)] + [(2, "a", "z")], "doc_id bigint, text string, start string")
    got = H.token_file_rows(docs, PATH, with_ids=True).collect()
    tokenizer, at = Tokenizer.from_file(PATH), 0
    want = {}
    rows = [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]
    for key, ids in sorted(rows, key=lambda r: (r[0], np.array(r[1], "<u2").tobytes())):
        want[at] = (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    assert {r["start"]: (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got} == want
    assert H.token_file_rows(docs.limit(0), PATH).count() == 0


def test_files_roll_over_and_wide_ids(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more " * (i % 7)) for i in range(300)] + [(None, "first")], "doc_id bigint, text string")
    one, many = (sorted(H.token_file_rows(docs, PATH, file_tokens=n).collect(), key=lambda r: r["start"]) for n in (1 << 20, 50))
    assert one == many and [r["doc_id"] for r in one] == [None, *range(300)]
    wide = H.token_file_rows(docs, PATH, end_id=70_000, with_ids=True)
    narrow = {r["doc_id"]: r["ids"] for r in H.token_file_rows(docs, PATH, with_ids=True).collect()}
    assert {r["doc_id"]: r["ids"] for r in wide.collect()} == {k: [*v[:-1], 70_000] for k, v in narrow.items()}


def test_more_ids_than_sixteen_bits_name():
    rng = np.random.default_rng(2)
    ids = rng.permutation(90_000).astype(np.uint32)
    lengths = H.code_lengths(np.bincount(ids), H.limit_for(90_000))
    assert lengths.max() == 17
    data = H.write_run(5, [ids[:70_000], ids[70_000:]], [1, 2], lengths, H.canonical(lengths))
    back = list(H.read_run(data))
    assert [(k, s) for k, s, _ in back] == [(1, 5), (2, 70_005)] and (np.concatenate([r[2] for r in back]) == ids).all()


def test_damaged_files():
    with pytest.raises(ValueError):
        list(H.read_run(b"nothing"))
