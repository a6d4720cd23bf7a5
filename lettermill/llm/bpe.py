"""Byte-level BPE by a hierarchical-bitmap rank queue (operator 4).

Every pre-token is merged on its own. A merge rank has a bucket of positions of
a linked list of symbols; a two-level bitmap over the ranks says which bucket
is the lowest with entries (find-first-set), and entries whose pair has changed
since are skipped. A pre-token of n bytes takes O(n) queue operations, however
long it is.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import blocks, row_blocks, task, text_bytes
from .wordids import KNOWN_UNITS, UnitIds, gather

ENCODE_BYTES = 4 << 20  # texts encoded together
MERGE_BYTES = 1 << 20  # bytes of new pre-tokens that share a queue; a longer one has its own
LOOKUP = 1 << 18  # pairs looked up at once
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_LEAF = 8  # bits of a rank that select within a leaf of the bitmap


@lru_cache(maxsize=1)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Positions bucketed by rank; the lowest rank is found by two find-first-set steps."""

    __slots__ = ("buckets", "leaves", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.leaves: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        got = self.buckets.get(rank)
        if got is None:
            self.buckets[rank] = [position]
            leaf = rank >> _LEAF
            self.leaves[leaf] = self.leaves.get(leaf, 0) | 1 << (rank & 255)
            self.top |= 1 << leaf
        else:
            got.append(position)

    def push_all(self, ranks: list[int], at: list[int]) -> None:
        get = self.buckets.get
        for rank, i in zip(ranks, at, strict=True):
            bucket = get(rank)
            if bucket is None:
                self.push(rank, i)
            else:
                bucket.append(i)

    def lowest(self) -> int:
        """The lowest rank with entries, or -1."""
        top = self.top
        if not top:
            return -1
        leaf = (top & -top).bit_length() - 1
        bits = self.leaves[leaf]
        return leaf << _LEAF | (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        got = self.buckets.pop(rank)
        leaf = rank >> _LEAF
        left = self.leaves[leaf] & ~(1 << (rank & 255))
        self.leaves[leaf] = left
        if not left:
            self.top &= ~(1 << leaf)
        return got


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # where the symbol that starts here ends; 0: it is part of another
    before = list(range(-1, n))
    pair = [-1] * n  # the rank of the pair that starts here
    queue = RankQueue()
    get, push = ranks.get, queue.push
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            pair[i] = r
            push(r, i)
    rank = queue.lowest()
    while rank >= 0:
        todo = queue.take(rank)
        todo.sort()
        lower = False
        for k, i in enumerate(todo):
            if pair[i] != rank:
                continue  # stale
            j = end[i]
            stop = end[j]
            end[i], end[j], pair[j] = stop, 0, -1
            pair[i] = -1
            if stop < n:
                before[stop] = i
                r = get(piece[i : end[stop]])
                if r is not None:
                    pair[i] = r
                    push(r, i)
                    lower = lower or r < rank
            b = before[i]
            if b >= 0:
                r = get(piece[b:stop])
                if r is None:
                    pair[b] = -1
                else:
                    pair[b] = r
                    push(r, b)
                    lower = lower or r < rank
            if lower and k + 1 < len(todo):  # a pair that comes first has formed: the rest waits
                for x in todo[k + 1 :]:
                    if pair[x] == rank:
                        push(rank, x)
                break
        rank = queue.lowest()
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@lru_cache(maxsize=1)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (left id * 2^32 + right id) of all pairs that merge, and the merged ids."""
    ranks = load_ranks(path)
    keys, out = [], []
    for token, r in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                out.append(r)
    keys, out = np.array(keys, np.int64), np.array(out, np.int32)
    order = np.argsort(keys)
    return keys[order], out[order]


def merge_many(pieces: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each pre-token, all their ids) through one rank queue.

    Pre-tokens don't touch each other, so all positions of the lowest bucket
    are merged together. Should a merge form a pair of a lower rank, the rest
    of that pre-token's bucket would have to wait: such pre-tokens are done
    again by `merge`.
    """
    ranks = load_ranks(path)
    keys, merged = pair_table(path)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(data)
    at_kind = np.int32 if n < 1 << 30 else np.int64
    lengths = np.array([len(p) for p in pieces], np.int64)
    stop = np.cumsum(lengths)
    byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    tok = np.append(byte_id[data], np.int32(-1))  # the id of the symbol that starts here, -1: none
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    limit = np.append(stop.astype(at_kind)[owner], at_kind(0)) if n else np.zeros(1, at_kind)
    nxt = np.arange(1, n + 2, dtype=at_kind)
    prv = np.arange(-1, n, dtype=at_kind)
    first = np.zeros(n + 1, bool)
    first[stop - lengths] = True

    def pairs(at: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each position, -1: none."""
        right = nxt[at]
        ok = right < limit[at]
        key = tok[at].astype(np.int64) << 32 | tok[np.where(ok, right, n)]
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(ok & (keys[i] == key), merged[i], np.int32(-1))

    # in pieces, so that what a lookup needs besides stays small
    pair = np.concatenate([np.full(0, -1, np.int32), *(pairs(np.arange(a, min(a + LOOKUP, n))) for a in range(0, n, LOOKUP)), np.full(1, -1, np.int32)])
    queue = RankQueue()
    live = np.flatnonzero(pair[:-1] >= 0)
    order = live[np.argsort(pair[live], kind="stable")]
    cuts = np.flatnonzero(np.diff(pair[order])) + 1
    if len(order):
        every, starts = order.tolist(), [0, *cuts.tolist()]
        for a, b, r in zip(starts, [*starts[1:], len(every)], pair[order[starts]].tolist(), strict=True):
            queue.push(r, every[a])
            queue.buckets[r] = every[a:b]
    again: set[int] = set()
    rank = queue.lowest()
    while rank >= 0:
        at = _distinct(np.array(queue.take(rank), np.int64))
        at = at[pair[at] == rank]  # the others are stale
        if len(at) > 1:  # of a chain a-a-a take every second
            chained = np.append(False, nxt[at[:-1]] == at[1:])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[run % 2 == 0]
        if len(at):
            right = nxt[at]
            after = nxt[right]
            tok[at] = rank
            tok[right] = -1
            pair[right] = -1
            nxt[at] = after
            inner = after < limit[at]
            prv[after[inner]] = at[inner]
            left = prv[at][~first[at]]
            todo = _distinct(np.concatenate((at, left))) if len(left) else at
            new = pairs(todo)
            pair[todo] = new
            ok = new >= 0
            new, todo = new[ok], todo[ok]
            queue.push_all(new.tolist(), todo.tolist())
            again.update(owner[todo[new < rank]].tolist())
        rank = queue.lowest()
    ids = tok[:-1]
    kept = ids >= 0
    count = np.add.reduceat(kept, stop - lengths, dtype=np.int64) if n else np.zeros(0, np.int64)
    out = ids[kept].astype("<u4")
    if again:
        parts = np.split(out, np.cumsum(count)[:-1])
        for k in again:
            parts[k] = np.array(merge(pieces[k], ranks), "<u4")
        count, out = np.array([len(x) for x in parts], np.int64), np.concatenate(parts)
    return count, out


def _distinct(at: np.ndarray) -> np.ndarray:
    """Sorted different positions."""
    at.sort()
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


class Encoder(UnitIds):
    """Texts to packed ids and back; units are split by the pattern, and each distinct pre-token is merged once in a block."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, most: int = KNOWN_UNITS) -> None:
        super().__init__(self._merged, most=most, block=ENCODE_BYTES)
        self.path = path
        self.split = regex.compile(pattern).findall
        self.ranks = load_ranks(path)
        size = max(self.ranks.values()) + 1
        self.table = [b""] * size
        for k, v in self.ranks.items():
            self.table[v] = k

    def _merged(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        index: dict[str, int] = {}
        at, ends = [], [0]
        for u in units:
            at += [index.setdefault(piece, len(index)) for piece in self.split(u.decode("utf-8", "replace"))]
            ends.append(len(at))
        pieces, at = [p.encode() for p in index], np.array(at, np.int64)
        got = [merge_many(pieces[i:j], self.path) for i, j in blocks(np.array([len(p) for p in pieces], np.int64), MERGE_BYTES)]
        count, ids = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        total = np.append(0, np.cumsum(count[at]))
        return np.diff(total[ends]), gather(ids, (np.cumsum(count) - count)[at], count[at])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and `ids` (array<int>): the tokens of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(path)
        for batch in batches:
            for i, j, rows in row_blocks(batch.column(1), ENCODE_BYTES):
                packed = own.encode_all(rows)
                ids = pa.array([np.frombuffer(p, "<i4") for p in packed], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(task(run), f"doc_id {kind}, ids array<int>")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(path)
        for batch in batches:
            for i, j, rows in row_blocks(batch.column(1), ENCODE_BYTES):
                packed = own.encode_all(rows)
                n = [len(p) // 4 for p in packed]
                ids = [hashlib.sha256(p).hexdigest() for p in packed]
                back = [hashlib.sha256(own.decode(p)).hexdigest() for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return task(run)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text; one row per input row.

    Null and empty texts have no tokens (digests of the empty string); a very
    long text is encoded whole, in a block of its own; repeated rows give
    repeated results; a null id stays null; other columns are ignored; an empty
    table gives no rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(
        _digests(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
