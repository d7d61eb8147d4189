"""Suffix arrays by Larsson-Sadakane refinement and Kasai's common prefixes, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

CHAIN = 128  # places of one chain of common prefixes


def joined(parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts one after another, each followed by a zero byte; where each begins; and how much is left of it at each place."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    begins = np.r_[0, np.cumsum(sizes + 1)[:-1]].astype(np.int64)
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    left = np.repeat(begins + sizes, sizes + 1) - np.arange(len(text))
    return text, begins, left


def packed(text: np.ndarray, width: int) -> np.ndarray:
    """The next ``width`` bytes at each place as one number, the first byte highest."""
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(width):
        out = (out << np.uint64(8)) | padded[k:k + len(text)]
    return out


def equal_bytes(difference: np.ndarray) -> np.ndarray:
    """How many of the highest bytes are zero."""
    same = (difference == 0).astype(np.int64)
    for k in range(1, 8):
        same += difference < np.uint64(1 << 8 * k)
    return same


def ordering(key: np.ndarray, bits: int) -> np.ndarray:
    """Places in the order of their keys of ``bits`` bits, equal ones as they come.

    Sorting numbers is several times faster than sorting places, so a key that leaves room for its place carries it.
    """
    width = max(len(key).bit_length(), 1)
    if bits + width > 64:
        return np.argsort(key, kind="stable")
    numbers = np.sort((key << np.uint64(width)) | np.arange(len(key), dtype=np.uint64))
    return (numbers & np.uint64((1 << width) - 1)).astype(np.int64)


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, each of which ends with its part.

    Places are sorted by as many first bytes as fit into a number beside the place, a byte taking the bits
    that the text's own alphabet needs, and get the number of their group. In each round only groups of
    more than one are sorted again, by the group numbers as far ahead as has been compared, which doubles
    the compared length. The end of a part is below any byte, and earlier ends are below later.
    """
    n = len(text)
    width = max(n.bit_length(), 1)
    known = np.cumsum(np.bincount(text, minlength=256) > 0).astype(np.uint64)  # zero is the end of a part
    bits = int(known[-1]).bit_length()
    h = max((64 - width) // bits, 1)
    symbols = np.concatenate([np.where(left > 0, known[text], np.uint64(0)), np.zeros(h, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key = (key << np.uint64(bits)) | symbols[k:k + n]
    late = np.flatnonzero(left < h)
    beyond = ((h - left[late]) * bits).astype(np.uint64)  # what follows the end is another part
    key[late] = key[late] >> beyond << beyond
    sa = ordering(key, h * bits)
    ordered, ended = key[sa], left[sa] < h
    first = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1]) | ended[1:] | ended[:-1]])
    sizes = np.diff(np.r_[first, n])
    group = np.empty(n, np.uint32 if n < 1 << 32 else np.uint64)
    group[sa] = np.repeat(first, sizes)
    open_ = np.repeat(sizes > 1, sizes)
    at, some, sizes = np.flatnonzero(open_), sa[open_], sizes[sizes > 1]
    while len(at):
        own = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(width), sizes)
        key = own | group[np.minimum(some + h, n - 1)]
        order = ordering(key, width + len(sizes).bit_length())
        some, key = some[order], key[order]
        sa[at] = some
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[first, len(at)])
        group[some] = np.repeat(at[first], sizes)
        open_ = np.repeat(sizes > 1, sizes)
        at, some, sizes = at[open_], some[open_], sizes[sizes > 1]
        h *= 2
    return sa


def chains(begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``lengths`` places from ``begins`` on, cut into chains of ``CHAIN`` places at most: their begins and lengths, the longest first."""
    cuts = -(-lengths // CHAIN)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    starts = np.repeat(begins, cuts) + nth * CHAIN
    sizes = np.minimum(np.repeat(lengths, cuts) - nth * CHAIN, CHAIN)
    order = np.argsort(-sizes, kind="stable")
    return starts[order], sizes[order]


def common_prefixes(text: np.ndarray, begins: np.ndarray, left: np.ndarray, sa: np.ndarray, most: int, least: int = 1) -> np.ndarray:
    """Kasai's lengths: what each suffix shares with the one before it in ``sa``, up to ``most`` bytes.

    A part is followed from its begin: at the next place at most one byte less is shared. Parts are cut into
    chains of bounded size, each of which compares its first place from the start, and all chains advance side by
    side, eight bytes at a comparison, so that a long part takes no more steps than others. A part is followed up to where
    fewer than ``least`` bytes are left, and places behind it get 0: who asks which suffixes share ``least``
    bytes needs no more, as a shorter one never lies between two of these.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    words = packed(text, 8)
    shared = np.zeros(n, np.int32)
    begins, lengths = chains(begins, np.maximum(left[begins] - least + 1, 0))
    h = np.zeros(len(begins), np.int64)
    for step in range(int(lengths[0]) if len(begins) else 0):
        alive = int(np.searchsorted(-lengths, -step, side="left"))  # chains longer than the step
        i = begins[:alive] + step
        j = before[i]
        has = j >= 0
        most_here = np.where(has, np.minimum(np.minimum(left[i], left[np.maximum(j, 0)]), most), 0)
        g = np.minimum(np.maximum(h[:alive] - 1, 0), most_here)
        go = np.flatnonzero(g < most_here)
        while len(go):
            same = equal_bytes(words[i[go] + g[go]] ^ words[j[go] + g[go]])
            g[go] = np.minimum(g[go] + same, most_here[go])
            go = go[(same == 8) & (g[go] < most_here[go])]
        h[:alive] = g
        shared[i] = g
    return shared[sa]
