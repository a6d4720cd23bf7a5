"""Removal of repeated byte strings by blockwise suffix sorting (operator 1).

Every string of LENGTH bytes belongs to one anchor, its GRAM-byte gram of the least
hash (the first of equals), so equal strings have equal anchors. A text is cut
into pieces: runs of strings with the same anchor. Strings whose anchor's gram
occurs once cannot repeat and need no sorting. All other pieces are dealt by
anchor, distinct pieces once with their number of occurrences, and every task
sorts the suffixes of its pieces block by block with a difference cover
(`suffixes`), which flags the strings that occur more than once.

An anchor of more than GROUP distinct pieces, such as one in a passage that very
many texts share, is refined: its pieces are cut into runs of 16 strings, dealt by
the bytes that all 16 share, and sorted in the same way. A group that is still too
large is cut into runs of 4 strings and of 2, which share more bytes; equal runs
are counted before they are dealt, so that only those are left that differ within
the few bytes around what they share. Single strings are dealt only of passages of
just LENGTH bytes that go on differently at both ends. So no task holds a group
that grows with the data, and hot passages come through the suffix order too.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, mix, powers, quoted, row_blocks, rows_of, schema_of, task, temporary, text_bytes, whole_row
from .suffixes import repeated

LENGTH = 400
GRAM = 32  # the shorter, the fewer pieces a text has; it only has to be rare by chance
GROUP = 500  # distinct pieces of a key that are sorted in one task, at most
RUNS = (16, 4, 2, 1)  # strings of a refined piece, from pass to pass; those of 2 that differ at one end alone are 256 at most
CHAIN = 3  # pieces of a text that are looked up together, on average
SORT_BYTES = 1 << 20  # piece bytes sorted together
SEGMENT = 1 << 20  # strings of a text that are anchored together
_LOW = np.uint64((1 << 24) - 1)


def _anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Each string's anchor position, and each position's gram hash."""
    p, q = powers(len(data) + 1)
    pre = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=pre[1:])
    n = len(data) - gram + 1
    h = mix((pre[gram:] - pre[:-gram]) * q[:n])
    key = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
    width = length - gram + 1
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = key
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(full, axis=1).reshape(-1)
    strings = len(data) - length + 1
    best = np.minimum(ahead[:strings], behind[width - 1 : width - 1 + strings])
    return (best & _LOW).astype(np.int64), h


def pieces(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(start, strings, anchor's distance from the start, anchor's gram hash) of a text's pieces."""
    total = len(text) - length + 1
    for a in range(0, max(total, 0), SEGMENT):
        n = min(SEGMENT, total - a)
        anchor, h = _anchors(np.frombuffer(text, np.uint8, n + length - 1, a), length, gram)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        count = np.diff(np.append(first, n))
        own = anchor[first]
        yield from zip((first + a).tolist(), count.tolist(), (own - first).tolist(), h[own].astype(np.int64).tolist(), strict=True)


def _hash(data: bytes, seed: int = 0) -> int:
    h = xxhash.xxh3_64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def text_key(text: str = "text") -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text_bytes(text)).alias("t1"), F.xxhash64(F.lit(1), text_bytes(text)).alias("t2")]


def _cut(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, rows in row_blocks(batch.column(0)):
                owner, cols = [], [[] for _ in range(5)]
                for k, text in enumerate(rows, i):
                    for start, n, far, h in pieces(text, length, gram):
                        owner.append(k)
                        for col, v in zip(cols, (start, n, far, h, _hash(text[start : start + n + length - 1])), strict=True):
                            col.append(v)
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), *(pa.array(c, pa.int64()) for c in cols)], ["d", "t1", "t2", "start", "n", "far", "ah", "sh"])

    return run


UNITS = "key long, uh long, weight long, hot boolean, dist long, body binary"
PARTS = "key long, uh long, weight long, dist long, body binary, pk long, pu long, off long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[t]) for c, t in enumerate(types)], list(names))


def _units(length: int):
    """A text's pieces that stand for all equal ones, by anchor; dist: how far the anchor is from a piece's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in row_blocks(batch.column(0)):
                lists = batch.column(1).slice(i, j - i).to_pylist()
                yield _batch([(p["ah"], p["sh"], p["weight"], p["hot"], p["far"], text[p["start"] : p["start"] + p["n"] + length - 1]) for text, own in zip(texts, lists, strict=True) for p in own], UNITS)

    return run


def _parts(length: int, size: int):
    """Pieces of large groups to runs of `size` strings: those whose distances to the anchor have the same quotient.

    A run's key is the hash of the bytes that all strings of the full run share;
    equal strings lie in runs of equal keys, at equal distances.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, bodies in row_blocks(batch.column(4)):
                rows, others = [], (c.slice(i, j - i).to_pylist() for c in batch.columns[:4])
                for key, uh, weight, dist, body in zip(*others, bodies, strict=True):
                    n, off = len(body) - length + 1, 0
                    while off < n:
                        q = (dist - off) // size  # strings whose distance to the anchor is in [q * size, (q + 1) * size)
                        stop = min(n, dist - q * size + 1)
                        shared = body[dist - q * size : dist - q * size - size + 1 + length]
                        own = body[off : stop + length - 1]
                        rows.append((_hash(shared, key + q & 0xFFFFFFFF), _hash(own, dist - off), weight, dist - off, own, key, uh, off))
                        off = stop
                yield _batch(rows, PARTS)

    return run


def _sorted(length: int):
    """Flags repeated strings of the pieces; rows come sorted by key."""

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        key, uh = table.column(0).to_numpy(), table.column(1).to_numpy()
        weight = table.column(2).to_numpy()
        order = np.lexsort((uh, key))  # a repeated piece enters once
        order = order[np.append(True, (key[order][1:] != key[order][:-1]) | (uh[order][1:] != uh[order][:-1]))]
        body = table.column(3).combine_chunks().to_pylist()
        body = [body[k] for k in order.tolist()]
        size = np.array([len(b) for b in body])
        start = np.cumsum(size) - size
        n = size - length + 1
        owner = np.repeat(np.arange(len(body)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flag = repeated(np.frombuffer(b"".join(body), np.uint8), start[owner] + at, weight[order][owner], length)
        edge = np.flatnonzero(flag)
        if not len(edge):
            return
        new = np.append(True, (np.diff(edge) > 1) | (owner[edge[1:]] != owner[edge[:-1]]))
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(edge)))
        k = order[owner[edge[first]]]
        yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(uh[k]), pa.array(at[edge[first]]), pa.array(run)], ["key", "uh", "o", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size < SORT_BYTES:
                continue
            table = pa.concat_tables(rest)
            key = table.column(0).to_numpy()
            lengths = np.cumsum([len(b) for b in table.column(3).to_pylist()])
            i, last = 0, int(np.searchsorted(key, key[-1]))  # the last key may go on
            change = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            while i < last:
                j = int(np.searchsorted(lengths, (lengths[i - 1] if i else 0) + SORT_BYTES))
                j = min(last, int(change[np.searchsorted(change, max(j, i + 1))]))
                yield from flush(table.slice(i, j - i))
                i = j
            rest = [table.slice(last)]
            size = rest[0].nbytes if rest[0].num_rows < table.num_rows else 0
        if rest:
            yield from flush(pa.concat_tables(rest))

    return run


def _sort(units: DataFrame, length: int, what: str) -> DataFrame:
    own = units.select("key", "uh", "weight", "body").repartition("key").sortWithinPartitions("key")
    return materialise(own.mapInArrow(task(_sorted(length)), "key long, uh long, o long, n long"), what)


def _refined(pieces: DataFrame, length: int, group: int, sizes: tuple[int, ...] = RUNS) -> DataFrame:
    """Repeated strings (key, uh, o, n) of the pieces (key, uh, weight, dist, body) of large groups, pass by pass."""
    parts = materialise(pieces.mapInArrow(task(_parts(length, sizes[0])), PARTS), "runs")
    distinct = parts.groupBy("key", "uh").agg(F.sum("weight").alias("weight"), F.first("dist").alias("dist"), F.first("body").alias("body"))
    distinct = materialise(distinct, "distinct-runs")
    counts = distinct.groupBy("key").agg(F.count("*").alias("m"))
    sized = materialise(distinct.join(counts, "key"), "sized-runs")
    discard(distinct)
    last = len(sizes) == 1  # single strings: those of a key are equal, and so one
    found = _sort(sized if last else sized.filter(F.col("m") <= group), length, "found-runs")
    large = sized.filter(F.col("m") > group).select("key", "uh", "weight", "dist", "body")
    if not last and not large.isEmpty():
        found = found.unionByName(_refined(large, length, group, sizes[1:]))
    up = parts.select("key", "uh", "pk", "pu", "off").join(found, ["key", "uh"]).select(F.col("pk").alias("key"), F.col("pu").alias("uh"), (F.col("off") + F.col("o")).alias("o"), "n")
    up = materialise(up, "found-in-runs")
    discard(parts, sized)
    return up


@temporary
def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of repeated strings of each different text: t1, t2, spans (array of first string and number of strings)."""
    rows = docs.select(text_bytes(text_col).alias("t"), F.col(quoted(id_col)).alias("d"), *text_key(text_col))
    kind = rows.schema["d"].dataType.simpleString()
    long_enough = rows.filter(F.length("t") >= length)
    cut = long_enough.mapInArrow(task(_cut(length, gram)), f"d {kind}, t1 long, t2 long, start long, n long, far long, ah long, sh long")
    # counts per piece of a distinct text: copies of a text collapse before anything else
    all_pieces = materialise(cut.groupBy("t1", "t2", "start", "n", "far", "ah", "sh").agg(F.count("*").alias("c"), F.min("d").alias("d")), "pieces")
    twice = materialise(all_pieces.groupBy("ah").agg(F.sum("c").alias("w")).filter("w > 1").select("ah"), "anchors")
    own = materialise(all_pieces.join(twice, "ah"), "own-pieces")
    discard(all_pieces, twice)
    chains = _chains(own)
    stands = own.groupBy("ah", "sh").agg(F.sum("c").alias("weight"), F.min(F.struct("t1", "t2", "start", "n", "far", "d")).alias("r"))
    stands = materialise(stands.select("ah", "sh", "weight", "r.*"), "stands")
    discard(own)
    sizes = stands.groupBy("ah").agg(F.count("*").alias("m"))
    lists = stands.join(sizes, "ah").withColumn("hot", F.col("m") > group)
    lists = lists.groupBy("t1", "t2").agg(F.min("d").alias("hd"), F.collect_list(F.struct("start", "n", "far", "ah", "sh", "weight", "hot")).alias("p"))
    # one document stands for all of its text; should it be repeated itself, all its strings are repeated anyway
    lists = lists.withColumnsRenamed({"t1": "h1", "t2": "h2"})
    mine = (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")) & F.col("d").eqNullSafe(F.col("hd"))
    units = materialise(long_enough.join(lists, mine).select("t", "p").mapInArrow(task(_units(length)), UNITS), "units")
    discard(stands)
    found = _sort(units.filter("not hot"), length, "found")
    hot = units.filter("hot").select("key", "uh", "weight", "dist", "body")
    if not hot.isEmpty():
        found = found.unionByName(_refined(hot, length, group))
    found = found.select(F.col("key").alias("ah"), F.col("uh").alias("sh"), "o", "n")
    # a piece's runs travel as one row, at most as many as it has strings
    by_piece = materialise(found.groupBy("ah", "sh").agg(F.collect_list(F.struct("o", "n")).alias("runs")), "found-by-piece")
    discard(units)
    each = chains.groupBy("k1", "k2").agg(F.first("pieces").alias("pieces")).select("k1", "k2", F.explode("pieces").alias("p")).select("k1", "k2", "p.*")
    each = each.join(by_piece, ["ah", "sh"]).select("k1", "k2", F.flatten(F.transform("far", lambda f: F.transform("runs", lambda r: F.struct((f + r["o"]).alias("a"), r["n"].alias("n"))))).alias("runs"))
    each = each.groupBy("k1", "k2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    spans = chains.select("t1", "t2", "start", "k1", "k2").join(each, ["k1", "k2"])
    spans = spans.select("t1", "t2", F.transform("runs", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), r["n"].alias("n"))).alias("runs"))
    return materialise(spans.groupBy("t1", "t2").agg(F.flatten(F.collect_list("runs")).alias("spans")), "spans")


def _chains(own: DataFrame) -> DataFrame:
    """Neighbouring pieces of a text as one row: t1, t2, start, k1, k2 and the pieces (how far from the start, ah, sh).

    A piece that a text holds many times, such as a line that it repeats, is one
    piece with many places. Chains begin at pieces that their own bytes choose, so
    texts with a passage in common have its chains in common: what is found in a
    passage is then looked up once for each of its chains, and meets the texts
    chain by chain.
    """
    once = own.select("t1", "t2", "start", "ah", "sh").repartition("t1", "t2").groupBy("t1", "t2", "ah", "sh").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    w = Window.partitionBy("t1", "t2").orderBy(F.col("starts")[0])
    number = F.sum((F.pmod("sh", F.lit(CHAIN)) == 0).cast("int")).over(w)
    rows = once.withColumn("number", number).groupBy("t1", "t2", "number").agg(F.array_sort(F.collect_list(F.struct("starts", "ah", "sh"))).alias("all"))
    start = F.col("all")[0]["starts"][0]
    rows = rows.select("t1", "t2", start.alias("start"), F.transform("all", lambda p: F.struct(F.transform(p["starts"], lambda x: x - start).alias("far"), p["ah"].alias("ah"), p["sh"].alias("sh"))).alias("pieces"))
    return materialise(rows.select("*", F.xxhash64("pieces").alias("k1"), F.xxhash64(F.lit(1), "pieces").alias("k2")), "chains")


def removed(size: int, spans: list[dict], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the strings of the spans."""
    out: list[list[int]] = []
    for a, n in sorted((s["a"], s["n"]) for s in spans):
        stop = a + n - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([a, stop])
    return [(a, min(b, size)) for a, b in out]


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in ranges:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in row_blocks(batch.column(2)):
                cols: list[list] = [[], [], []]
                for text, spans in zip(texts, batch.column(3).slice(i, j - i).to_pylist(), strict=True):
                    ranges = removed(len(text), spans, length)
                    cols[0].append(sum(b - a for a, b in ranges))
                    cols[1].append(len(ranges))
                    cols[2].append(hashlib.sha256(without(text, ranges)).hexdigest())
                keys = [batch.column(k).slice(i, j - i) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["t1", "t2", "n_removed", "n_spans", "kept"])

    return run


def removals(docs: DataFrame, length: int = LENGTH, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per input row.

    Null texts count as empty; texts shorter than `length` lose nothing; very
    long ones are taken whole, a segment of SEGMENT strings at a time; a repeated row is a further occurrence of its text; null ids stay null; other
    columns are ignored; an empty table gives no rows.
    """
    spans = repeated_runs(docs, length, group=group, id_col=id_col, text_col=text_col)
    texts = docs.select(text_bytes(text_col).alias("t"), *text_key(text_col)).filter(F.length("t") >= length)
    cut = texts.join(spans, ["t1", "t2"]).select("t1", "t2", "t", "spans")
    cut = cut.mapInArrow(task(_digest(length)), "t1 long, t2 long, n_removed long, n_spans long, kept string").dropDuplicates(["t1", "t2"])
    cut = materialise(cut, "removals")
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.length(text_bytes(text_col)).cast("long").alias("n_bytes"), F.sha2(text_bytes(text_col), 256).alias("whole"), *text_key(text_col))
    out = rows.join(cut, ["t1", "t2"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in row_blocks(batch.column(1)):
                there, new = batch.column(1).slice(i, j - i).is_valid().to_pylist(), []
                for text, ok, spans in zip(texts, there, batch.column(2).slice(i, j - i).to_pylist(), strict=True):
                    new.append(None if not ok else without(text, removed(len(text), spans, length)).decode("utf-8", "ignore") if spans else text.decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(new, pa.string())], ["row", "new"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with repeated strings cut out of their texts; one row per input row, all columns.

    A character cut in two goes whole; `count_col`, if given, follows the text's
    number of characters. Nulls stay null; empty and short texts stay as they
    are; very long ones are cut whole; equal texts lose all that they share; an empty table gives no rows.
    """
    spans = repeated_runs(docs, length, group=group, id_col=id_col, text_col=text_col)
    rows = docs.select(whole_row(docs).alias("row"), F.col(quoted(text_col)).cast("binary").alias("t"), *text_key(text_col))
    rows = rows.join(spans, ["t1", "t2"], "left").select("row", "t", "spans")
    got = rows.mapInArrow(task(_apply(length)), schema_of(rows, "row", "new string"))
    other = {text_col: F.col("new")}
    if count_col:
        kind = docs.schema[count_col].dataType
        other[count_col] = F.when(F.col("new").isNotNull(), F.length("new")).otherwise(F.col(f"row.{quoted(count_col)}")).cast(kind)
    return rows_of(got, docs.columns, **other)
