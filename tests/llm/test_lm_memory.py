"""What a worker of op2 holds of a block, beside the block itself."""

import tracemalloc

import numpy as np

from leitmotiv.llm import lm


def block(tokens: int, words: int) -> dict:
    rng = np.random.default_rng(5)
    t = rng.integers(0, words, tokens)
    t[99::100] = 0  # texts of 100 tokens
    lengths = np.full(tokens // 100, 100, np.uint64)
    return {"block": 3, "lengths": lm.pack(lengths), "train": np.ones(len(lengths), np.uint8).tobytes(), "vocabulary": rng.integers(0, 1 << 63, words, np.uint64).tobytes(), "tokens": lm.pack(t.astype(np.uint64))}


def test_a_walk_holds_few_copies_of_its_block():
    row, order, shards = block(200_000, 20_000), 3, 8
    answers = []
    for n, keys, _, inverse in lm._grams(row, order):
        counts = np.bincount(inverse, minlength=len(keys)).astype(np.uint64)
        cuts = np.r_[0, np.searchsorted(keys, lm._edges(shards)), len(keys)]
        answers += [{"n": n, "shard": s, "totals": lm.pack(counts[cuts[s] : cuts[s + 1]])} for s in range(shards)]
    tracemalloc.start()
    lm._score(row, answers, order, 5.0, 200_000, 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 230 * 200_000  # bytes a token
