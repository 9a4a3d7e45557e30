"""Deep-shallow sorting of fixed-width byte strings: multikey quicksort to a shallow depth, blind tries for what still ties."""

from __future__ import annotations

import numpy as np


def _runs(change: np.ndarray) -> np.ndarray:
    """Numbers of the runs that begin where change is true."""
    return np.cumsum(change) - 1


SMALL = 1024  # strings of a part that ordinary sorting finishes, as quicksorts do


def multikey(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by the first depth columns, and the group of equal prefixes of each place in it.

    Multikey quicksort with eight bytes as a character: each part is split three ways by its pivot's character - less, equal, greater -
    and the equal strings go on with the next one; all parts of a round are split together. Parts of at most SMALL strings are
    sorted at once by the characters that are left.
    """
    n = len(words)
    order = np.arange(n)
    begins = np.zeros(n + 1, dtype=bool)  # where a part begins whose strings are done with, or equal as far as depth
    begins[[0, n]] = True
    start, end, col = np.array([0]), np.array([n]), np.array([0])
    while len(start):
        small = end - start <= SMALL
        for c in np.unique(col[small]):
            pick = small & (col == c)
            _finish(words, depth, int(c), start[pick], end[pick], order, begins)
        start, end, col = start[~small], end[~small], col[~small]
        if not len(start):
            break
        size = end - start
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        part = np.repeat(np.arange(len(start)), size)
        key = words[order[at], col[part]]
        begin = np.cumsum(size) - size
        three = np.sort(np.stack([key[begin], key[begin + size // 2], key[begin + size - 1]]), axis=0)
        side = (key > three[1][part]).astype(np.int8) - (key < three[1][part]).astype(np.int8)
        lane = part * 3 + side + 1
        order[at] = order[at[np.argsort(lane, kind="stable")]]
        counts = np.bincount(lane, minlength=3 * len(start))
        to = np.cumsum(counts.reshape(-1, 3), axis=1) + start[:, None]
        limits = np.concatenate([start[:, None], to], axis=1)
        start, end = limits[:, :3].ravel(), limits[:, 1:].ravel()
        col = (col[:, None] + np.array([0, 1, 0])).ravel()
        begins[start[end > start]] = True
        more = (end - start > 1) & (col < depth)
        start, end, col = start[more], end[more], col[more]
    return order, _runs(begins[:n])


def _finish(words: np.ndarray, depth: int, col: int, start: np.ndarray, end: np.ndarray, order: np.ndarray, begins: np.ndarray) -> None:
    """Sort parts by the characters from col on."""
    size = end - start
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    if not len(at):
        return
    part = np.repeat(np.arange(len(start)), size)
    own = order[at]
    by = np.lexsort((*(words[own, c] for c in range(depth - 1, col - 1, -1)), part))
    order[at] = own = own[by]
    change = np.ones(len(at), dtype=bool)
    change[1:] = (part[1:] != part[:-1]) | (words[own[1:], col:depth] != words[own[:-1], col:depth]).any(axis=1)
    begins[at[change]] = True


def blind_tries(strings: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and leaves after each group's strings, equal in the first depth bytes, went through a blind trie.

    The first string of a group is its path. Another one branches off where its common prefix with the path ends; of the trie
    only that depth and the byte there are kept. What branches off at one place by one byte is a trie of its own, built in
    the next round; all groups' tries grow together. A string without a branch ends in the path's leaf.
    """
    n, width = strings.shape
    order, leaf = order.copy(), group.copy()
    if not n or depth >= width:
        return order, leaf
    open_ = np.bincount(leaf)[leaf] > 1
    at = np.flatnonzero(open_)
    node = leaf[at]
    while len(at):
        first = np.ones(len(at), dtype=bool)
        first[1:] = node[1:] != node[:-1]
        pivot = order[at[first]][_runs(first)]
        own = order[at]
        differs = strings[own, depth:] != strings[pivot, depth:]
        some = differs.any(axis=1)
        place = np.where(some, differs.argmax(axis=1) + depth, width)
        near = np.minimum(place, width - 1)
        byte, path = strings[own, near].astype(np.int64), strings[pivot, near].astype(np.int64)
        side = np.where(~some, 0, np.where(byte < path, -1, 1))
        # before the path's leaf: low branches from the top down; after it: high branches from the bottom up
        rank = np.where(side < 0, place, np.where(side > 0, -place, 0))
        by = np.lexsort((byte * some, rank, side, node))
        order[at] = own[by]
        node, side, rank, byte, some = node[by], side[by], rank[by], (byte * some)[by], some[by]
        change = np.ones(len(at), dtype=bool)
        change[1:] = (node[1:] != node[:-1]) | (side[1:] != side[:-1]) | (rank[1:] != rank[:-1]) | (byte[1:] != byte[:-1])
        sub = _runs(change)
        begins = np.zeros(n, dtype=bool)  # where leaves or sub-tries begin, on top of the old limits
        begins[0] = True
        begins[1:] = leaf[1:] != leaf[:-1]
        begins[at] |= change
        leaf = _runs(begins)
        more = some & (np.bincount(sub)[sub] > 1)
        at, node = at[more], sub[more]
    return order, leaf


def deep_shallow(strings: np.ndarray, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of strings (n, a multiple of eight bytes), and the number of the distinct string at each place of it."""
    words = np.ascontiguousarray(strings).view(">u8").astype(np.uint64)
    order, group = multikey(words, shallow // 8)
    return blind_tries(strings, order, group, shallow)
