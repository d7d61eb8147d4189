"""Common prefixes of long parts are followed in many chains side by side."""

import random

import numpy as np

from dqspark.llm import suffix


def test_a_long_part_takes_no_more_steps_than_others(monkeypatch):
    calls, equal = [], suffix.equal_bytes
    monkeypatch.setattr(suffix, "equal_bytes", lambda difference: calls.append(1) or equal(difference))
    r = random.Random(3)
    parts = [b"ab" * 10_000, bytes(r.choice(b"ab") for _ in range(700)), b"ab" * 300]
    text, begins, left = suffix.joined(parts)
    sa = suffix.suffix_array(text, left)
    shared = suffix.common_prefixes(text, begins, left, sa, 400, 400)
    assert len(calls) < 1000
    own = [bytes(text[i:i + min(left[i], 400)]) for i in sa]
    want = [len(b) == 400 and a == b for a, b in zip(own, own[1:])]
    assert (shared >= 400).tolist() == [False, *want] and sum(want) > 19_000


def test_chains_cover_every_place_once():
    begins, lengths = np.array([0, 10, 500, 2000]), np.array([3, 0, suffix.CHAIN, 3 * suffix.CHAIN + 1])
    starts, sizes = suffix.chains(begins, lengths)
    assert sizes.max() <= suffix.CHAIN and sizes.tolist() == sorted(sizes, reverse=True)
    assert sorted(i for a, n in zip(starts, sizes) for i in range(a, a + n)) == [i for a, n in zip(begins, lengths) for i in range(a, a + n)]
