import random

import public_tokenizers
import sentencepiece
from cuewright.llm.token_counts import PieceMerger, count_tokens, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(7)
    letters = "aeb thero \n\t▁  日本語é😀<s></s>▁0.1%　x"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "  a  ", "\n", "a" * 500, " " * 200, "<s> </s> <unk> <0x0A>", "x" * 70 + "日本語" * 30]
    for alphabet in ("a", "ab", "the", "aàe", "0123", "ingtheration", "日本 語"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.choice([130, 700, 3000]))) for _ in range(12)]
    assert count_tokens(texts, PATH) == [len(ids) for ids in model.encode(texts)]


def test_leftmost_of_equal_pairs_merges_first():
    merger = PieceMerger(["a", "b", "aa", "ab"], [-9, -9, -1, -2], [True] * 4)
    assert merger.count(["aaab", "ab", "", "aaaa"]) == [2, 1, 0, 2]


def test_rows(spark):
    rows = [(1, "hello world", 5, "x"), (1, "hello world", 5, "x"), (2, None, 0, "y"), (3, "", 0, None), (None, "é", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint, n_bytes string")
    got = sorted(token_counts(docs, PATH, limit=1).collect(), key=str)
    n, m = map(len, sentencepiece.SentencePieceProcessor(model_file=PATH).encode(["hello world", "é"]))
    want = [("1", 11, n, n > 1), ("1", 11, n, n > 1), ("2", 0, 0, False), ("3", 0, 0, False), ("None", 2, m, m > 1)]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_long_runs_take_few_rounds():
    assert count_tokens(["a" * 300_000, "ab" * 200_000], PATH) == [len(ids) for ids in sentencepiece.SentencePieceProcessor(model_file=PATH).encode(["a" * 300_000, "ab" * 200_000])]
