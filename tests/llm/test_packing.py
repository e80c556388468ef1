import random
import zlib

import numpy as np
import public_tokenizers
from cuewright.llm.packing import BestFit, best_fit
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(lengths, size, bins):
    """Best fit by looking at every open bin."""
    open_bins, made, out = [], 0, []  # [number, free]
    for n in lengths:
        fitting = [b for b in open_bins if b[1] >= n]
        if fitting:
            least = min(b[1] for b in fitting)
            b = [x for x in fitting if x[1] == least][-1]
            open_bins.remove(b)
        else:
            if len(open_bins) >= bins:
                least = min(x[1] for x in open_bins)
                open_bins.remove([x for x in open_bins if x[1] == least][-1])
            b, made = [made, size], made + 1
        out.append((b[0], size - b[1]))
        if b[1] > n:
            open_bins.append([b[0], b[1] - n])
    return out


def test_best_fit_equals_brute_force():
    rng = random.Random(3)
    for bins in (1, 2, 5, 1000):
        lengths = [rng.randint(1, 64) for _ in range(2000)]
        fit = BestFit(64, bins)
        assert [fit.place(n) for n in lengths] == brute(lengths, 64, bins)
        assert fit.open <= bins


def test_the_bound_acts_and_costs_little(spark):
    rng = random.Random(5)
    texts = ["the " * min(5000, int(rng.lognormvariate(5.5, 1.2))) for _ in range(9000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = best_fit(docs, PATH, size=2048).collect()
    least = -(-sum(r["length"] for r in got) // 2048)
    assert len({r["sequence_id"] for r in got}) <= 1.01 * least
    fit = BestFit(2048, 1024)
    lengths = [min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(40_000)]
    for at in range(0, len(lengths), 2000):
        for n in sorted(lengths[at : at + 2000], reverse=True):
            fit.place(n)
            assert fit.open <= 1024
    assert fit.closed > 0 and fit.made <= 1.01 * -(-sum(lengths) // 2048)


def test_pieces(spark):
    texts = ["hello world", None, "", "a b c " * 100, "w " * 31, "same", "same"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(6, "same", 1), (None, "q", 1)], "doc_id bigint, text string, length int")
    got = best_fit(docs, PATH, size=32, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    whole = {}
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["piece"])):
        assert r["length"] == len(r["ids"]) <= 32 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["start"] == 32 * r["piece"]
        if r["doc_id"] != 6:
            whole.setdefault(r["doc_id"], []).extend(r["ids"])
    for i, t in enumerate(texts[:6]):
        assert whole[i] == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for runs in places.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 32
    assert best_fit(docs.limit(0), PATH).count() == 0
