import random

import numpy as np
import xxhash

from lodestar.llm import line_dedup, words


def test_word_hashes_are_xxh64():
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abcXYZ019é語 \t\n_.-İß", k=rnd.randint(0, 300))) for _ in range(60)] + ["", " ", "x" * 31, "y" * 32, "z" * 500]
    for text in texts:
        data = np.frombuffer(line_dedup.words_only(text), np.uint8)
        first, end = words.word_bounds((data != 32) & (data != 10))
        found = [w for line in text.split("\n") for w in line_dedup.normalise(line).split()]
        assert [data[a:b].tobytes().decode() for a, b in zip(first, end, strict=True)] == found
        assert words.xxh64_words(data, first, end).tolist() == [xxhash.xxh64_intdigest(w) for w in found]
