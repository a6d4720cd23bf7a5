"""Blockwise suffix sorting with a difference cover.

Suffixes are sorted one bucket of leading bytes at a time. Within a bucket they
are told apart by eight bytes at a time, up to the cover's period; suffixes that
still tie are compared by ranks of the cover sample, computed once: for any two
positions i, j there is a distance d below the period at which both i + d and
j + d belong to the sample. So a bucket needs memory for its own suffixes only,
and repeats of any length cost no more than those of one period.
"""
from __future__ import annotations

import numpy as np

# A perfect difference set, all distances modulo 73 from 9 residues.
COVER = (1, 2, 4, 8, 16, 32, 37, 55, 64)
PERIOD = 73
BUCKET_ROWS = 1 << 17


def _distances() -> np.ndarray:
    """For each pair of residues the least d that brings both into the cover."""
    member = np.isin(np.arange(PERIOD), COVER)
    i, j = np.meshgrid(np.arange(PERIOD), np.arange(PERIOD), indexing="ij")
    out = np.full((PERIOD, PERIOD), -1)
    for d in range(PERIOD - 1, -1, -1):
        out[member[(i + d) % PERIOD] & member[(j + d) % PERIOD]] = d
    return out


DISTANCE = _distances()


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The next eight bytes of each position as a big-endian number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data)] << np.uint64(8 * (7 - k))
    return out


def _dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Ranks from a sorted order and where a new value begins."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(words: np.ndarray) -> np.ndarray:
    """Rank of each sample suffix; 0 elsewhere and past the end.

    words: eight_bytes of the text. A sample position plus the period is a
    sample position, so ranks of doubled depth come from pairs of ranks.
    """
    n = len(words)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.zeros(n + PERIOD, np.int64)
    if not len(at):
        return rank
    steps = -(-PERIOD // 8)  # covers the period, a little more
    keys = [np.where(at + 8 * k < n, words[np.minimum(at + 8 * k, n - 1)], np.uint64(0)) for k in range(steps)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(at), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    rank[at] = _dense(order, new)
    reach = PERIOD
    while reach < n and not new.all():
        later = np.where(at + reach < n, rank[np.minimum(at + reach, n + PERIOD - 1)], 0)
        order = np.lexsort((later, rank[at]))
        a, b = rank[at][order], later[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        rank[at] = _dense(order, new)
        reach *= 2
    return rank


def _merge_ties(rows: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sorts positions within runs of equal `group` by cover ranks: merge sort, all runs at once."""

    def key(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = DISTANCE[i % PERIOD, j % PERIOD]
        return rank[np.minimum(i + d, len(rank) - 1)], rank[np.minimum(j + d, len(rank) - 1)]

    rows = rows.copy()
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    stop = np.append(start[1:], len(rows))
    width = 1
    while True:
        wide = stop - start > width
        if not wide.any():
            return rows
        size = (stop - start)[wide]
        first = np.repeat(start[wide], size)
        last = np.repeat(stop[wide], size)
        p = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first
        inside = (p - first) // width
        in_left = inside % 2 == 0
        # the neighbouring run, searched for each element's place
        lo = first + np.where(in_left, inside + 1, inside - 1) * width
        lo, hi = np.minimum(lo, last), np.minimum(lo + width, last)
        begin = lo.copy()
        mine = rows[p]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            a, b = key(rows[mid], mine[open_])
            before = np.where(in_left[open_], a < b, a <= b)
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        run = first + (inside - np.where(in_left, 0, 1)) * width  # where the pair of runs starts
        own = p - (first + inside * width)
        out = rows.copy()
        out[run + own + (lo - begin)] = mine
        rows = out
        width *= 2


def sort_suffixes(data: np.ndarray, rows: np.ndarray, bucket_rows: int = BUCKET_ROWS):
    """Yields the positions `rows` in order of their suffixes, bucket by bucket; PERIOD bytes follow each of them."""
    words = eight_bytes(data)
    n = len(words)
    rank = cover_ranks(words)
    lead = (words[rows] >> np.uint64(40)).astype(np.int64)  # buckets are ranges of three leading bytes
    by = np.argsort(lead, kind="stable")
    rows, lead = rows[by], lead[by]
    i = 0
    while i < len(rows):
        j = int(np.searchsorted(lead, lead[min(i + bucket_rows, len(rows)) - 1], "right"))
        own = rows[i:j]
        order = np.argsort(words[own], kind="stable")
        own = own[order]
        k = words[own]
        group = np.cumsum(np.append(True, k[1:] != k[:-1]))
        reach = 8
        while reach < PERIOD:  # runs that tie so far, by the next eight bytes
            tied = np.zeros(len(own), bool)
            same = group[1:] == group[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            t = np.flatnonzero(tied)
            if not len(t):
                break
            at = own[t] + reach
            k = np.where(at < n, words[np.minimum(at, n - 1)], np.uint64(0))
            order = np.lexsort((k, group[t]))
            own[t], k = own[t][order], k[order]
            fresh = np.zeros(len(own), np.int64)
            fresh[t[1:]] = (k[1:] != k[:-1]) & (group[t[1:]] == group[t[:-1]])
            group = group + np.cumsum(fresh)
            reach += 8
        else:
            same = np.append(False, group[1:] == group[:-1])
            tied = same | np.append(same[1:], False)
            t = np.flatnonzero(tied)
            if len(t):
                own[t] = _merge_ties(own[t], group[t], rank)
        yield own
        i = j


def repeated(data: np.ndarray, rows: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Flags the rows whose string of `length` bytes has a total weight above 1 among all rows."""
    out = np.zeros(len(rows), bool)
    place = np.zeros(len(data), np.int64)
    place[rows] = np.arange(len(rows))
    for own in sort_suffixes(data, rows):
        same = np.zeros(len(own), bool)
        words = np.lib.stride_tricks.sliding_window_view(data, length)
        for i in range(1, len(own), 8192):  # neighbours are compared byte by byte
            a, b = own[i - 1 : i + 8191][: len(own) - i], own[i : i + 8192]
            a = a[: len(b)]
            head = data[a] == data[b]
            k = np.flatnonzero(head)
            same[i + k] = (words[a[k]] == words[b[k]]).all(1)
        k = place[own]
        group = np.cumsum(~same) - 1
        out[k] = np.bincount(group, weight[k])[group] > 1
    return out
