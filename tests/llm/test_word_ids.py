import random
from array import array

import public_tokenizers
from cuewright.llm import word_ids
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_library():
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(4)
    letters = list("abThe'sLl..,,!!%?|#$&*;:-_09²½ßÀÿİΣσςǅé́ͅ \n\t\x1c\x85　日한") + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'re", "'S", "ﬁ", "Å", "😀"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(8000)]
    want = [array("I", e.ids).tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = word_ids.encode(texts, PATH)
    assert [(t, g) for t, g, w in zip(texts, got, want) if g != w] == []
