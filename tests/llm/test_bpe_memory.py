"""A tokenizer's memos stay small however many words a worker meets: two workers stand beside a heap in one executor's memory."""

import json
import random
import sys

from leitmotiv.llm import bpe, registry


def held(x, seen: set[int]) -> int:
    """Bytes of x and what it holds."""
    if id(x) in seen:
        return 0
    seen.add(id(x))
    inside = [*x, *x.values()] if isinstance(x, dict) else x if isinstance(x, list | tuple) else [vars(x)] if hasattr(x, "__dict__") else []
    return sys.getsizeof(x) + sum(held(y, seen) for y in inside)


def test_memos_of_a_worker_stay_below_100_mb():
    with open(registry.vocabulary(), encoding="utf-8") as f:
        spec = f.read()
    own = bpe.WordBPE(json.loads(spec))
    rng = random.Random(6)
    syllables = [a + b + c for a in "bdfgklmnprstvw" for b in "aeiou" for c in "lnrst"]
    common = b"The cat's hat, and the dog."
    first, before = own.encode(common), held(own, set())
    for _ in range(300):
        own.encode(common + b" " + " ".join("".join(rng.choices(syllables, k=4)) + "," for _ in range(1000)).encode())
    assert own.encode(common) == first
    assert held(own, set()) - before < 100e6


def test_a_memo_forgets_the_longest_unasked_first():
    memo = bpe.Memo(3)
    for k in range(20):
        memo.put(k, str(k))
        assert memo.get(0) == "0" and len(memo.new) + len(memo.old) <= 6
    assert memo.get(19) == "19" and memo.get(5) is None
