"""N-gram Jaccard join by chosen paths (operator 5).

Texts with equal sets of word five-grams form a class. A class's set is embedded
as SLOTS min-hash tokens (slot, value). A run sends every set down a random tree:
at each node a few slots, picked by a hash of the path so far, split the sets by
their tokens, and sets that agree share a child. Buckets of up to LIMIT sets are
compared pair by pair. A larger one is split again, or ends there if a sample of
its sets is alike, so that splitting would not lessen the pairs to compare; the
sample only picks the way, either way compares all that the bucket holds. Runs
are repeated until the chance to miss a pair at the threshold is below 1 - RECALL.
Every pair found is verified on the whole sets, exactly.

The large buckets that end are compared whole, but no pair twice: each set has
one home, the largest such bucket that it is in, and homes that meet in a bucket
are compared with one another, block against block. Sets of homes that meet are
stored as their difference from one of them, the hub: with r(A) hub n-grams that
A lacks and D(A) the difference, |A & B| = |hub| - r(A) - r(B) + |D(A) & D(B)|,
so near copies are compared by the few n-grams in which they differ. Links are
counted, and only a spanning forest is listed.

No bucket is gathered into one task unless it is small: counts and homes are
aggregates that Spark combines early, joins by path can be split, and a block
has a bounded number of sets and n-grams.
"""
from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, blocks, byte_rows, materialise, mix, quoted, row_blocks, rows_of, task, temporary, text_bytes, whole_row, words

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.99
SLOTS = 64
LIMIT = 24
ROOT_SLOTS = 2  # slots that a run's root splits by
DEPTH = 4  # levels of a run; sets in a bucket of the last agree in four tokens, and its large buckets are compared whole, however mixed
MARGIN = 0.15  # an estimate from SLOTS tokens is off by less (three standard deviations)
SAMPLE = 48  # sets of a large bucket that show whether it is alike, about
BLOCK, BLOCK_SIZE = 512, 1 << 18  # sets, and n-grams of sets, that a block of a home has on average at most
_C = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(rows: list[bytes], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word n-grams of each text as sorted 64-bit hashes, and where each text's begin.

    A text of fewer words has one n-gram of all its words; one without words has none.
    """
    h, first = words(rows, WORD_TABLE)
    n = np.diff(first)
    take = np.where(n >= gram, n - gram + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(rows)), take)
    at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + first[row]
    got = np.zeros(len(at), np.uint64)
    for k in range(gram):
        inside = at + k < first[row + 1]
        got[inside] = got[inside] * _C + h[at[inside] + k]
    got = mix(got)
    order = np.lexsort((got, row))
    got, row = got[order], row[order]
    new = np.append(True, (got[1:] != got[:-1]) | (row[1:] != row[:-1])) if len(got) else np.zeros(0, bool)
    got, row = got[new], row[new]
    return got, np.searchsorted(row, np.arange(len(rows) + 1))


def sketches(sets: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Min-hash tokens (texts, slots); all ones for an empty set."""
    out = np.full((len(first) - 1, slots), 0xFFFFFFFF, np.uint32)
    own = np.flatnonzero(np.diff(first))
    if not len(own):
        return out
    x, starts = (sets >> np.uint64(32)).astype(np.uint32), first[own]
    seeds = mix(np.arange(1, 2 * slots + 1, dtype=np.uint64))
    for k in range(slots):
        y = (x ^ np.uint32(seeds[2 * k] >> np.uint64(32))) * np.uint32(seeds[2 * k + 1] & np.uint64(0xFFFFFFFF) | np.uint64(1))
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[own, k] = np.minimum.reduceat(y, starts)
    return out


def _class_keys(rows: list[bytes], sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits of each text's set; of the text itself where it has no words."""
    import xxhash

    return [xxhash.xxh3_128_digest(sets[a:b].tobytes() if b > a else b"\0" + r) for r, a, b in zip(rows, first[:-1], first[1:], strict=True)]


def _sketched(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, rows in row_blocks(batch.column(0)):
                sets, first = shingle_sets(rows, gram)
                part = batch.slice(i, j - i)
                tokens = [x.tobytes() for x in sketches(sets, first)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(_class_keys(rows, sets, first), pa.binary()), pa.array(np.diff(first), pa.int64()), pa.array(tokens, pa.binary())],
                    [*part.schema.names[1:], "c", "size", "sketch"],
                )

    return run


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, two hashes of the text, class key, set size, sketch."""
    rows = docs.select(
        text_bytes(text_col).alias("t"), F.col(quoted(id_col)).alias("doc_id"),
        F.xxhash64(text_bytes(text_col)).alias("t1"), F.xxhash64(F.lit(1), text_bytes(text_col)).alias("t2"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialise(rows.mapInArrow(task(_sketched(gram)), f"doc_id {kind}, t1 long, t2 long, c binary, size long, sketch binary"), "sketches")


def runs_needed(threshold: float, recall: float, root: int = ROOT_SLOTS, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold is missed with a chance of at most 1 - recall.

    A node hands a pair on to Poisson(similarity / threshold) shared children.
    """
    alive = 1.0
    for _ in range(depth - 1):
        alive = 1 - math.exp(-alive)
    hit = 1 - (1 - threshold * alive) ** root
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _roots(runs: int):
    """Sets to the children of every run's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1)).astype(np.uint64)
            for r in range(runs):
                for k in range(ROOT_SLOTS):
                    slot = (r * ROOT_SLOTS + k) % SLOTS
                    path = mix(mix(x[:, slot] + np.uint64(slot << 32)) + np.uint64(r + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(path.astype(np.int64)), batch.column(0)], ["path", "c"])

    return run


def _children(threshold: float):
    """Sets of a bucket (path, c, sketch) to the bucket's children: slots by a hash of the path, 1 / threshold on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, salts = np.uint64(int(2**32 / (threshold * SLOTS))), np.arange(1, SLOTS + 1, dtype=np.uint64) * _C
        for batch in batches:
            path = batch.column(0).to_numpy().astype(np.uint64)
            x = _matrix(batch.column(2)).astype(np.uint64)
            for slot, salt in enumerate(salts):
                pick = np.flatnonzero(mix(path + salt) >> np.uint64(32) < most)
                if len(pick):
                    child = mix(mix(path[pick] + np.uint64(slot)) + x[pick, slot])
                    yield pa.RecordBatch.from_arrays([pa.array(child.astype(np.int64)), batch.column(1).take(pa.array(pick))], ["path", "c"])

    return run


def _brute_force(least: float):
    """Pairs within small buckets whose tokens agree enough; rows come sorted by path."""

    def pairs(path: np.ndarray, c: list[bytes], x: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        a, b = [], []
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(path)], strict=True):
            for k in range(i, j - 1):
                like = np.flatnonzero((x[k + 1 : j] == x[k]).mean(1) >= least) + k + 1
                for m in like.tolist():
                    lo, hi = sorted((c[k], c[m]))
                    a.append(lo)
                    b.append(hi)
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            path = table.column(0).to_numpy()
            done = int(np.searchsorted(path, path[-1]))  # the last bucket may go on in the next batch
            rest = table.slice(done).combine_chunks()
            yield from emit(table.slice(0, done))
        if rest is not None:
            yield from emit(rest)

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            table = table.combine_chunks()
            a, b = pairs(table.column(0).to_numpy(), table.column(1).to_pylist(), _matrix(table.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _alike(least: float):
    """Whether a bucket's sampled sets share `least` of their tokens on average; rows come sorted by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, x in runs_of(batches):
            n = len(x)
            if n > 1:
                shared = sum(int((np.unique(x[:, k], return_counts=True)[1].astype(np.int64) ** 2).sum()) for k in range(x.shape[1]))
                like = (shared / x.shape[1] - n) / (n * (n - 1))  # of the pairs of different sets
            else:
                like = 1.0
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.int64()), pa.array([like >= least])], ["path", "ends"])

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            path, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(path)], strict=True):
                if last is not None and path[i] != last:
                    yield last, np.concatenate(held)
                    held = []
                last = int(path[i])
                held.append(x[i:j])
        if last is not None:
            yield last, np.concatenate(held)

    return run


@temporary
def candidates(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(pairs (a < b) of class keys that may reach the threshold, buckets to compare whole as rows of path, c, n)."""
    spark = classes.sparkSession
    least = threshold - MARGIN
    rows = materialise(classes.select("c", "sketch").mapInArrow(task(_roots(runs_needed(threshold, recall))), "path long, c binary"), "rows")
    found, whole = [], [spark.createDataFrame([], "path long, c binary, n long")]
    for depth in range(DEPTH):
        shared = materialise(rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), "paths")
        level = rows.join(shared, "path").select("path", "c", "n")
        level = materialise(level.join(classes.select("c", "sketch"), "c").select("path", "c", "sketch", "n"), "level")
        small = level.filter(F.col("n") <= limit).select("path", "c", "sketch").repartition("path").sortWithinPartitions("path")
        found.append(small.mapInArrow(task(_brute_force(least)), "a binary, b binary"))
        large = level.filter(F.col("n") > limit)
        if depth == DEPTH - 1:
            whole.append(large.select("path", "c", "n"))
            break
        few = F.pmod(F.xxhash64("path", "c"), F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE))) == 0
        sample = large.filter(few).select("path", "sketch").repartition("path").sortWithinPartitions("path")
        kinds = materialise(sample.mapInArrow(task(_alike(least)), "path long, ends boolean"), "kinds")
        # one join marks all rows of the level; a large bucket without a sampled set is compared whole
        marked = materialise(level.select("path", "c", "n").join(kinds, "path", "left").select("path", "c", "n", F.coalesce("ends", F.col("n") > limit).alias("ends"), (F.col("n") > limit).alias("large")), "marked")
        whole.append(marked.filter("ends and large").select("path", "c", "n"))
        rows = marked.filter("large and not ends").join(classes.select("c", "sketch"), "c").select("path", "c", "sketch")
        rows = materialise(rows.mapInArrow(task(_children(threshold)), "path long, c binary"), "children")
        if rows.isEmpty():
            break
    return materialise(functools.reduce(DataFrame.unionByName, found).distinct(), "pairs"), materialise(functools.reduce(DataFrame.unionByName, whole), "whole")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different (path, home) among the buckets of a batch's sets."""
    for batch in batches:
        lists = batch.column(1)
        home = np.repeat(batch.column(0).to_numpy(), np.asarray(lists.value_lengths()))
        got = np.unique(np.stack([lists.flatten().to_numpy(), home], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["path", "home"])


@temporary
def homes(whole: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, home, cluster of homes that meet, block of each set in buckets to compare whole; pairs home <= other that meet)."""
    own = whole.groupBy("c").agg(F.max(F.struct("n", "path")).alias("h"), F.collect_list("path").alias("paths"))
    own = materialise(own.select("c", F.col("h.path").alias("home"), "paths"), "own-homes")
    at = materialise(own.select("home", "paths").mapInArrow(task(_places), "path long, home long").distinct(), "meetings")
    meet = materialise(at.join(at.withColumnRenamed("home", "other"), "path").filter("home <= other").select("home", "other").distinct(), "met")
    apart = meet.filter("home < other").select(F.col("home").alias("a"), F.col("other").alias("b"))
    groups = components(apart).withColumnsRenamed({"node": "home", "label": "cluster"})
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SIZE)).cast("int")
    own = own.select("c", "home").join(classes.select("c", "size"), "c")
    sizes = own.groupBy("home").agg(parts.alias("blocks")).join(groups, "home", "left").select("home", "blocks", F.coalesce("cluster", "home").alias("cluster"))
    dealt = own.join(sizes, "home").select("c", "home", "cluster", F.pmod(F.xxhash64("home", "c"), "blocks").cast("int").alias("block"))
    return materialise(dealt, "dealt"), meet


def _set_rows(gram: int):
    """Texts to their sets, as bytes of sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, rows in row_blocks(batch.column(0)):
                sets, first = shingle_sets(rows, gram)
                got = [sets[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(got, pa.binary())], [*part.schema.names[1:], "s"])

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets to what tells them from their hub: size, hub n-grams that are missing, and the symmetric difference."""
    for batch in batches:
        size, lacks, hub_size, diff = [], [], [], []
        for s, h in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            x, y = np.frombuffer(s, np.uint64), np.frombuffer(h, np.uint64)
            d = np.setxor1d(x, y, assume_unique=True)
            size.append(len(x))
            hub_size.append(len(y))
            lacks.append((len(d) - len(x) + len(y)) // 2)
            diff.append(d.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.int64()) for x in (size, lacks, hub_size)), pa.array(diff, pa.binary())], ["home", "block", "c", "size", "lacks", "hub", "d"])


class Block:
    """Sets of a block: keys, sizes, hub n-grams they lack, and differences from the hub."""

    def __init__(self, members: list[dict]) -> None:
        self.c = [m["c"] for m in members]
        self.size, self.lacks = (np.array([m[k] for m in members], np.int64) for k in ("size", "lacks"))
        self.d = [np.frombuffer(m["d"], np.uint64) for m in members]


def linked(x: Block, y: Block | None, hub: int, threshold: float, label: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """(links of each set, links that join sets of different labels, each label once, new labels): x against y, or x within itself.

    Sets of y are numbered after those of x, and so are their labels.
    """
    n = len(x.c)
    both = [x] if y is None else [x, y]
    size, lacks = (np.concatenate([getattr(b, k) for b in both]) for k in ("size", "lacks"))
    sets = [d for b in both for d in b.d]
    kinds, at = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.array([len(d) for d in sets]) + 1  # a place that is never marked leads each set: none is empty
    first = np.append(0, np.cumsum(count))
    places = np.full(first[-1], len(kinds))
    lead = np.zeros(first[-1], bool)
    lead[first[:-1]] = True
    places[~lead] = at
    mark, degree, label, forest = np.zeros(len(kinds) + 1, np.int32), np.zeros(len(sets), np.int64), label.copy(), []
    for k in range(n):
        lo = k + 1 if y is None else n
        if lo == len(sets):
            break
        own = places[first[k] + 1 : first[k + 1]]
        mark[own] = 1
        common = hub - lacks[k] - lacks[lo:] + np.add.reduceat(mark[places[first[lo] :]], first[lo:-1] - first[lo])
        mark[own] = 0
        hits = np.flatnonzero((common > 0) & (common / np.maximum(size[k] + size[lo:] - common, 1) >= threshold)) + lo
        degree[k] += len(hits)
        degree[hits] += 1
        new, one = np.unique(label[hits], return_index=True)
        apart = new != label[k]
        if apart.any():
            forest += [(k, int(hits[m])) for m in one[apart]]
            label[np.isin(label, new)] = label[k]
    return degree, forest, label


_EDGES = pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary())]))
EDGES = "array<struct<a:binary,b:binary>>"


def _edges(forest: list[tuple[int, int]], c: list[bytes]) -> list[dict]:
    return [dict(zip("ab", sorted((c[k], c[m])), strict=True)) for k, m in forest]


def _within(threshold: float):
    """Links inside each block: degrees and labels of its sets, and a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = Block(batch.column(3)[k].as_py())
                degree, forest, label = linked(own, None, batch.column(2)[k].as_py(), threshold, np.arange(len(own.c)))
                out = [pa.array([degree.tobytes()], pa.binary()), pa.array([label.tobytes()], pa.binary()), pa.array([_edges(forest, own.c)], _EDGES)]
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, *out], [*batch.schema.names, "degree", "label", "edges"])

    return run


def _across(threshold: float):
    """Links between two blocks: a row of degrees for each, the first with links that join labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                x, y = Block(row["m"]), Block(row["om"])
                label = np.concatenate([np.frombuffer(row["label"], np.int64), np.frombuffer(row["olabel"], np.int64) + len(x.c)])
                degree, forest, _ = linked(x, y, row["hub"], threshold, label)
                n = len(x.c)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["home"], row["other"]], pa.int64()), pa.array([row["i"], row["j"]], pa.int32()),
                    pa.array([degree[:n].tobytes(), degree[n:].tobytes()], pa.binary()), pa.array([_edges(forest, x.c + y.c), []], _EDGES),
                ], ["home", "block", "degree", "edges"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    """A block's degrees, added up."""
    total = sum(np.frombuffer(x, np.int64) for x in table["degree"].to_pylist())
    return pa.table({"home": table["home"][:1], "block": table["block"][:1], "degree": pa.array([total.tobytes()], pa.binary())})


def _degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            n = np.frombuffer(batch.column(1)[k].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, pa.array(n)], ["c", "n"])


def block_links(dealt: DataFrame, meet: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(number of links n of each class c in homes that meet, links a, b of a spanning forest)."""
    sets = texts.join(dealt, "c").select("t", "cluster", "home", "block", "c")
    sets = materialise(sets.mapInArrow(task(_set_rows(gram)), "cluster long, home long, block int, c binary, s binary"), "sets")
    hubs = materialise(sets.groupBy("cluster").agg(F.min(F.struct(F.xxhash64("c").alias("o"), "c", "s")).alias("h")).select("cluster", F.col("h.s").alias("h")), "hubs")
    diffs = sets.join(hubs, "cluster").select("home", "block", "c", "s", "h")
    diffs = diffs.mapInArrow(task(_differences), "home long, block int, c binary, size long, lacks long, hub long, d binary")
    own = diffs.groupBy("home", "block").agg(F.first("hub").alias("hub"), F.collect_list(F.struct("c", "size", "lacks", "d")).alias("m"))
    kind = own.schema["m"].dataType.simpleString()
    own = materialise(own.mapInArrow(task(_within(threshold)), f"home long, block int, hub long, m {kind}, degree binary, label binary, edges {EDGES}"), "blocks")
    at = own.select("home", "block")
    cells = meet.join(at.withColumnRenamed("block", "i"), "home").join(at.withColumnsRenamed({"home": "other", "block": "j"}), "other")
    cells = materialise(cells.filter("home < other or i < j").select("home", "i", "other", "j"), "cells")
    left = own.select("home", F.col("block").alias("i"), "hub", "m", "label")
    right = own.select(F.col("home").alias("other"), F.col("block").alias("j"), F.col("m").alias("om"), F.col("label").alias("olabel"))
    across = cells.join(left, ["home", "i"]).join(right, ["other", "j"])
    across = materialise(across.mapInArrow(task(_across(threshold)), f"home long, block int, degree binary, edges {EDGES}"), "across")
    total = own.select("home", "block", "degree").unionByName(across.select("home", "block", "degree"))
    total = total.groupBy("home", "block").applyInArrow(_summed, "home long, block int, degree binary")
    degree = own.select("home", "block", F.transform("m", lambda x: x["c"]).alias("c")).join(total, ["home", "block"])
    degree = materialise(degree.select("c", "degree").mapInArrow(task(_degrees), "c binary, n long"), "block-degrees")
    links = own.select("edges").unionByName(across.select("edges")).select(F.explode("edges").alias("e")).select("e.a", "e.b")
    return degree, links


def _verified(threshold: float, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = byte_rows(batch.column(2)), byte_rows(batch.column(3))
            for i, j in blocks(np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)])):
                texts = list(dict.fromkeys(left[i:j] + right[i:j]))
                at = {t: k for k, t in enumerate(texts)}
                sets, first = shingle_sets(texts, gram)
                cut = [sets[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                ok, jaccard = [], []
                for k in range(i, j):
                    x, y = cut[at[left[k]]], cut[at[right[k]]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    s = both / max(len(x) + len(y) - both, 1)
                    if both and s >= threshold:
                        ok.append(k)
                        jaccard.append(s)
                part = batch.take(pa.array(ok, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(jaccard, pa.float64())], ["a", "b", "jaccard"])

    return run


def class_texts(needed: DataFrame, docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """c and a text t of each class of `needed`."""
    reps = table.groupBy("c").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("r")).join(needed, "c")
    reps = reps.select("c", "r.doc_id", "r.t1", "r.t2")
    rows = docs.select(F.col(quoted(id_col)).alias("d"), text_bytes(text_col).alias("t"))
    rows = rows.select("d", "t", F.xxhash64("t").alias("x1"), F.xxhash64(F.lit(1), "t").alias("x2"))
    own = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("x1") == F.col("t1")) & (F.col("x2") == F.col("t2"))
    return materialise(rows.join(reps, own).groupBy("c").agg(F.first("t").alias("t")), "texts")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """Pairs whose whole sets reach the threshold, with their Jaccard similarity."""
    both = pairs.join(texts.withColumnsRenamed({"c": "a", "t": "ta"}), "a").join(texts.withColumnsRenamed({"c": "b", "t": "tb"}), "b")
    return materialise(both.select("a", "b", "ta", "tb").mapInArrow(task(_verified(threshold, gram)), "a binary, b binary, jaccard double"), "links")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each linked group, by label spreading with pointer jumping."""
    edges = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    if edges.isEmpty():
        return edges.withColumnsRenamed({"a": "node", "b": "label"})
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("m"))
        near = materialise(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label")), "near")
        far = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        got = materialise(near.join(far, "label").select("node", "was", F.least("label", "next").alias("label")), "labels")
        changed = not got.filter(F.col("was") != F.col("label")).isEmpty()
        labels = got.select("node", "label")
        if not changed:
            return labels


@temporary
def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, gram: int = GRAM, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(table with the group key `g` of each document row; number of links n_links of each class c that has any)."""
    table = sketch_table(docs, id_col, text_col, gram)
    classes = materialise(table.filter("size > 0").groupBy("c").agg(F.first("sketch").alias("sketch"), F.first("size").alias("size")), "classes")
    pairs, whole = candidates(classes, threshold, recall, limit)
    dealt, meet = homes(whole, classes)
    # pairs of homes that meet are counted block by block
    of = lambda end: dealt.select(F.col("c").alias(end), F.col("home").alias(f"h{end}"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    same = (F.least("ha", "hb") == F.col("home")) & (F.greatest("ha", "hb") == F.col("other")) & F.col("ha").isNotNull() & F.col("hb").isNotNull()
    pairs = materialise(pairs.join(meet, same, "left_anti").select("a", "b"), "candidates")
    needed = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).union(dealt.select("c")).distinct()
    texts = class_texts(needed, docs, table, id_col, text_col)
    links, (counted, forest) = verify(pairs, texts, threshold, gram), block_links(dealt, meet, texts, threshold, gram)
    labels = components(links.select("a", "b").union(forest)).withColumnsRenamed({"node": "c", "label": "g"})
    one = F.lit(1).cast("long").alias("n")
    ends = links.select(F.col("a").alias("c"), one).unionAll(links.select("b", one)).unionAll(counted)
    degree = materialise(ends.groupBy("c").agg(F.sum("n").alias("n_links")), "degrees")
    rows = table.drop("sketch").join(labels, "c", "left")
    return materialise(rows.withColumn("g", F.coalesce("g", "c")), "groups"), degree


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, group_id, n_links; one row per input row.

    class_id: the least id among texts of the same set of n-grams; group_id: the
    least id among all texts linked to it, directly or through others; n_links:
    links that its class has to other classes, counted without listing those of
    large groups. Texts of fewer than five words have one n-gram of all their
    words; null texts count as empty; texts without words equal only the very
    same text; very long texts enter whole; repeated rows share a class; null
    ids are ignored in minima (a group of null ids alone has null); other columns
    are ignored; an empty table gives no rows.
    """
    rows, degree = join(docs, threshold, recall, id_col=id_col, text_col=text_col)
    classes = materialise(rows.groupBy("c").agg(F.min("doc_id").alias("class_id")), "class-ids")
    groups = materialise(rows.groupBy("g").agg(F.min("doc_id").alias("group_id")), "group-ids")
    out = rows.join(classes, "c").join(groups, "g").join(degree, "c", "left")
    return out.select("doc_id", "class_id", "group_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of the least id of each group, all columns; of repeated rows one.

    Nulls and ties are treated as in near_duplicates: empty and null texts are
    one group; of equal ids with different texts in a group one stays.
    """
    rows, _ = join(docs, threshold, recall, id_col=id_col, text_col=text_col)
    keep = rows.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("r")).select("r.doc_id", "r.t1", "r.t2")
    keep = materialise(keep, "kept")
    own = docs.select(whole_row(docs).alias("row"), F.col(quoted(id_col)).alias("d"), F.xxhash64(text_bytes(text_col)).alias("x1"), F.xxhash64(F.lit(1), text_bytes(text_col)).alias("x2"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("x1") == F.col("t1")) & (F.col("x2") == F.col("t2"))
    out = own.join(keep, same)
    if not rows.groupBy("doc_id", "t1", "t2").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["d", "x1", "x2"])
    return rows_of(out, docs.columns)
