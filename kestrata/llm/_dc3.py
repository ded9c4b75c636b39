"""Suffix arrays by the difference cover {1, 2} modulo 3.

Sort the triples of the sampled positions, name them by rank, recurse on the
names until they are distinct or stand for enough characters, then merge in
the remaining suffixes by the first character and the rank behind it.
"""

from __future__ import annotations

import numpy as np


def _rank_rows(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the rows by the keys (first is most significant), dense names from 1, number of names."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) + 1
    return order, names, int(names[order[-1]]) if len(order) else 0


def _packed(text: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """Triples at the positions, in one key where three symbols fit in 63 bits."""
    a, b, c = text[at], text[at + 1], text[at + 2]
    width = max(1, int(top).bit_length())
    if 3 * width <= 63:
        return ((a << (2 * width)) | (b << width) | c,)
    return a, b, c


def suffix_ranks(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Rank (from 1) of each suffix of ``text`` (symbols >= 1).

    With ``depth``, the order is only exact for the first ``depth`` symbols:
    suffixes that agree that far stand next to each other in some order.
    """
    n = len(text)
    if n < 3:
        order = sorted(range(n), key=lambda i: tuple(text[i:]))
        out = np.empty(n, np.int64)
        out[order] = np.arange(1, n + 1)
        return out
    top = int(text.max())
    t = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    # the extra sample at n (all padding) keeps names of the two classes apart when n % 3 == 1
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    order, names, distinct = _rank_rows(*_packed(t, np.minimum(sample, n), top))
    if distinct < len(sample) and (depth is None or depth > 3):
        deeper = suffix_ranks(names, None if depth is None else -(-depth // 3))
    else:
        deeper = np.empty(len(sample), np.int64)
        deeper[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = deeper
    rank[n:] = 0
    # sampled suffixes in order, then the rest by (character, rank of the next)
    sampled = np.empty(len(sample), np.int64)
    sampled[deeper - 1] = sample
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.lexsort((rank[zeros + 1], t[zeros]))]
    # place of every remaining suffix among each class of the sample, by keys both sides have
    c1 = sampled[sampled % 3 == 1]
    c2 = sampled[sampled % 3 == 2]
    less1 = _count_less((t[c1], rank[c1 + 1]), (t[zeros], rank[zeros + 1]))
    less2 = _count_less((t[c2], t[c2 + 1], rank[c2 + 2]), (t[zeros], t[zeros + 1], rank[zeros + 2]))
    out = np.empty(n, np.int64)
    place = np.arange(len(zeros)) + less1 + less2
    # ties beyond the depth can make places run backwards; they stay neighbours
    place = np.maximum.accumulate(place - np.arange(len(zeros))) + np.arange(len(zeros))
    taken = np.zeros(n, bool)
    taken[place] = True
    out[zeros] = place + 1
    out[sampled] = np.flatnonzero(~taken) + 1
    return out


def _count_less(ours: tuple[np.ndarray, ...], theirs: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each of theirs (sorted), how many of ours (sorted) are smaller."""
    a, b = len(ours[0]), len(theirs[0])
    keys = [np.concatenate([x, y]) for x, y in zip(theirs, ours, strict=True)]  # theirs first: equal keys don't count
    order = np.lexsort(keys[::-1])
    mine = order >= b
    seen = np.cumsum(mine)
    out = np.empty(b, np.int64)
    out[order[~mine]] = seen[~mine]
    assert a == (seen[-1] if len(seen) else 0)
    return out


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    ranks = suffix_ranks(np.asarray(text), depth)
    out = np.empty(len(ranks), np.int64)
    out[ranks - 1] = np.arange(len(ranks))
    return out
