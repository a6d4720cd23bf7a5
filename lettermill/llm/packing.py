"""Hierarchical multi-length packing (operator 7).

A document's whole windows of the longest tier go out as they are. What is left
is routed to the shortest tier that holds it, each tier's windows are packed,
and gaps in longer windows are filled from shorter tiers, by whole remainders
where one fits and by a cut one otherwise. Windows of a tier are dealt into step
groups of equal token counts. Work is streamed: a task keeps one block of
documents and the few remainders carried into the next block, never a partition.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import row_blocks, task, text_bytes
from .wordids import TokenizerIds

VOCABULARY = "byte_bpe_50k.json"
TIERS = (1024, 512, 256, 128)  # context sizes, powers of two, longest first
STEP_TOKENS = 16_384  # tokens of a step group
END_ID = 0
PACK_BYTES = 4 << 20


@dataclass
class Piece:
    doc: int
    start: int
    length: int


class Pool:
    """Remainders by length; the longest that fits is one bit operation away."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[Piece]] = {}
        self.bits = 0
        self.tokens = 0

    def put(self, p: Piece) -> None:
        self.by_length.setdefault(p.length, []).append(p)
        self.bits |= 1 << p.length
        self.tokens += p.length

    def take(self, length: int) -> Piece:
        row = self.by_length[length]
        p = row.pop()
        if not row:
            del self.by_length[length]
            self.bits &= ~(1 << length)
        self.tokens -= length
        return p

    def longest(self, most: int) -> Piece | None:
        fit = self.bits & ((1 << (most + 1)) - 1)
        return self.take(fit.bit_length() - 1) if fit else None

    def cut(self, length: int) -> Piece | None:
        """The head of the longest remainder; its tail stays."""
        if not self.bits:
            return None
        p = self.take(self.bits.bit_length() - 1)
        self.put(Piece(p.doc, p.start + length, p.length - length))
        return Piece(p.doc, p.start, length)


def pack(lengths: list[tuple[int, int, int]], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Windows (tier, pieces) of the (doc, start, length) given, and what is carried on."""
    top = tiers[0]
    windows: list[tuple[int, list[Piece]]] = []
    pools = {w: Pool() for w in tiers}
    for doc, start, n in lengths:
        while n >= top:
            windows.append((top, [Piece(doc, start, top)]))
            start, n = start + top, n - top
        if n:
            pools[min(w for w in tiers if w >= n)].put(Piece(doc, start, n))
    carried: list[Piece] = []
    for k, w in enumerate(tiers):
        own, shorter = pools[w], [pools[x] for x in tiers[k + 1 :]]
        while own.tokens:
            window = [own.longest(w)]
            gap = w - window[0].length
            for pool in [own, *shorter]:
                while gap and (p := pool.longest(gap)):
                    window.append(p)
                    gap -= p.length
            for pool in [*reversed(shorter), own]:
                if gap and (p := pool.cut(gap)):
                    window.append(p)
                    gap = 0
            if gap:
                carried += window
            else:
                windows.append((w, window))
    if last and carried:  # less than a window of each tier: cut freely into the longest
        window, gap = [], top
        for p in carried:
            while p.length:
                n = min(gap, p.length)
                window.append(Piece(p.doc, p.start, n))
                p, gap = Piece(p.doc, p.start + n, p.length - n), gap - n
                if not gap:
                    windows.append((top, window))
                    window, gap = [], top
        if window:
            windows.append((top, window))
        carried = []
    return windows, carried


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _run(path: str, tiers: tuple[int, ...], step_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TokenizerIds(path)
        base = TaskContext.get().partitionId() << 33
        count, filled = 0, dict.fromkeys(tiers, 0)
        rest: dict[int, tuple[object, bytes]] = {}  # documents of which a part is carried
        carried: list[Piece] = []
        end = np.array([END_ID], "<u4").tobytes()
        kind = None

        def emit(windows: list[tuple[int, list[Piece]]], docs: dict[int, tuple[object, bytes]]) -> pa.RecordBatch:
            nonlocal count
            cols: list[list] = [[] for _ in range(9)]
            for tier, window in windows:
                at = 0
                group = tiers.index(tier) << 28 | filled[tier] // step_tokens
                for p in window:
                    key, packed = docs[p.doc]
                    crc = zlib.crc32(packed[4 * p.start : 4 * (p.start + p.length)])
                    for col, v in zip(cols, (key, p.start, p.length, crc, len(packed) // 4, base + count, at, tier, base + group), strict=True):
                        col.append(v)
                    at += p.length
                filled[tier] += at
                count += 1
            arrays = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for i, _, rows in row_blocks(batch.column(1), PACK_BYTES):
                packed = ids.encode_all(rows)
                docs = {k: v for k, v in enumerate(rest.values())}
                moved = {old: k for k, old in enumerate(rest)}
                first = len(docs)
                todo = [(moved[p.doc], p.start, p.length) for p in carried]
                for k, x in enumerate(packed):
                    docs[first + k] = (keys[i + k], x + end)
                    todo.append((first + k, 0, len(x) // 4 + 1))
                windows, carried = pack(todo, tiers, last=False)
                rest = {p.doc: docs[p.doc] for p in carried}
                yield emit(windows, docs)
        if carried:
            windows, _ = pack([(p.doc, p.start, p.length) for p in carried], tiers)
            yield emit(windows, rest)

    return task(run)


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of a document.

    Null and empty texts consist of the end id alone; very long texts are encoded
    whole and cut into as many pieces as they fill; repeated rows and ids are
    documents of their own; a null id stays null; other columns are ignored.
    Only a task's last sequence can be shorter than its tier. An empty table
    gives no rows. Sequence ids are unique, not dense.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(_run(path, tiers, step_tokens), f"doc_id {kind}, {SCHEMA}")
