"""Divergence of sources: how far each (language, source) group's word use lies from that of others, in exact integers.

A group's share of a term is p = 1 + floor(SCALE * (n + 1) / (N + V)), and the
divergence of p from q is floor((p - q)^2 / q), summed over all V kept terms of the
language. For two sources most terms are absent from both or from one; what these
give follows from counts of counts. The rest comes from a frequent-pattern tree:
each term is a path of its nonzero counts in order of source, equal beginnings are
one path with the number of terms on it, and each node and ancestor add what their
two counts change together once, times that number.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, quoted, task, text_bytes

SCALE_HIGH, SCALE_LOW = 100_000, 10_000  # shares are counted in units of 1 / (SCALE_HIGH * SCALE_LOW)
LEAST_DOCS = 3
TERMS_LISTED = 200
HELD = 200_000  # terms counted in a task before they are handed on
PIECE = 1 << 22  # bytes of a text split at once
BEGINNING = 4  # items of a path by which trees are dealt out
COMBINATIONS = 1 << 19  # of nodes and ancestors, worked out at once
#: A-Z as a-z, all else that is no letter or ASCII as a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a few megabytes at a time."""
    text = text.translate(LETTERS)
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


@task
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of the rows of a task, added up as far as memory allows."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rest() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            if n:
                keys = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array([source] * len(keys)), pa.array(keys, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([docs[k] for k in keys], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        seen.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, key in enumerate(zip(langs, sources, strict=True)):
            if key not in seen:
                seen[key] = Counter(), Counter()
            n, docs = seen[key]
            own: set[bytes] = set()
            for words in _terms(batch.column(2)[i].as_py()):
                n.update(words)
                own.update(words)
            docs.update(own)
            if i % 16 == 0 and sum(len(x[0]) for x in seen.values()) > HELD:
                yield from rest()
    yield from rest()


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), exact for totals below 9e13; n is less than total."""
    part = (n + 1) * SCALE_HIGH
    return 1 + _div(part, total) * SCALE_LOW + _div((part % total) * SCALE_LOW, total)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def term_rows(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Kept terms of each language: (lang, term, total, counts), counts holding source and n of each source that has it."""
    word = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    own = docs.select(word(lang).alias("lang"), word(source).alias("source"), text_bytes(text).alias("text"))
    n = own.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = n.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return rows.filter(F.col("docs") >= LEAST_DOCS).drop("docs")


def groups(docs: DataFrame, rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Every occurring group: (lang, source, terms = V, total = N + V, whole = N + V of the language, none = share of an absent term, place).

    place numbers a language's sources, those with most occurrences first.
    """
    word = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(c)
    there = docs.select(word(lang), word(source)).distinct().toDF("lang", "source")
    sums = rows.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    got = there.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "terms", "all"])
    got = got.select("lang", "source", "terms", (F.col("n") + F.col("terms")).alias("total"), (F.col("all") + F.col("terms")).alias("whole"))
    none = F.when(F.col("terms") > 0, share(F.lit(0), F.greatest("total", F.lit(1)))).otherwise(1)
    return got.select("*", none.alias("none"), F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "source")).alias("place"))


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def tree_corrections(starts: np.ndarray, place: np.ndarray, p: np.ndarray, none: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place a, place b, correction of a against b) of sorted term paths.

    Path r holds the items starts[r] to starts[r + 1] and stands for times[r]
    terms. A node begins at the first path that has it and ends before the first
    that differs up to it.
    """
    n, length = len(starts) - 1, np.diff(starts)
    row = np.repeat(np.arange(n), length)
    depth = np.arange(len(place)) - starts[row]
    before = starts[np.maximum(row - 1, 0)] + depth
    same = (row > 0) & (depth < length[np.maximum(row - 1, 0)])
    same[same] = (place[same] == place[before[same]]) & (p[same] == p[before[same]])
    shared = length.copy()  # items that a path shares with the one before
    np.minimum.at(shared, row[~same], depth[~same])
    shared[0] = 0
    upto = np.concatenate([[0], np.cumsum(times)])
    names, local = np.unique(place, return_inverse=True)
    k = len(names)
    there, back = np.zeros(k * k, np.int64), np.zeros(k * k, np.int64)
    for d in range(1, int(length.max(initial=0))):
        breaks = np.append(np.flatnonzero(shared <= d), n)
        first = breaks[:-1][length[breaks[:-1]] > d]
        weight = upto[breaks[np.searchsorted(breaks, first) + 1]] - upto[first]
        for i in range(0, len(first), max(1, COMBINATIONS // d)):
            own = (starts[first[i : i + max(1, COMBINATIONS // d)]] + d)[:, None]
            up = own - d + np.arange(d)[None, :]
            m = weight[i : i + len(own), None]
            a, b, a0, b0 = p[own], p[up], none[own], none[up]
            pair = (local[own] * k + local[up]).ravel()
            np.add.at(there, pair, (m * (_apart(a, b) - _apart(a, b0) - _apart(a0, b) + _apart(a0, b0))).ravel())
            np.add.at(back, pair, (m * (_apart(b, a) - _apart(b0, a) - _apart(b, a0) + _apart(b0, a0))).ravel())
    at = np.flatnonzero((there != 0) | (back != 0))
    a, b = names[at // k], names[at % k]
    return np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([there[at], back[at]])


@task
def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of each batch of sorted paths; a node that two batches share is one in each, for its terms there."""
    for batch in batches:
        langs, paths, times = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        code = langs.dictionary_encode()
        ends = np.append(np.flatnonzero(np.diff(code.indices.to_numpy())) + 1, len(langs)) if len(langs) else []
        begin = 0
        for end in ends:
            part = paths.slice(begin, end - begin)
            items = part.flatten()
            starts = part.offsets.to_numpy() - part.offsets[0].as_py()
            a, b, value = tree_corrections(starts, *[items.field(c).to_numpy() for c in ("place", "p", "none")], times[begin:end])
            if len(a):
                lang = langs[begin].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])
            begin = end


def _entries(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per term and source that has it: its share there (p) and in the language (q)."""
    flat = rows.select("lang", "term", F.col("total").alias("everywhere"), F.explode("counts").alias("c")).select("lang", "term", "everywhere", "c.source", "c.n")
    return flat.join(sources, ["lang", "source"]).select(
        "lang", "source", "term", "place", "none", share(F.col("n"), F.col("total")).alias("p"), share(F.col("everywhere"), F.col("whole")).alias("q")
    )


def pairs(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other one of its language."""
    own = _entries(rows, sources)
    item = F.struct(F.col("place").cast("int").alias("place"), "p", "none")
    paths = own.groupBy("lang", "term").agg(F.array_sort(F.collect_list(item)).alias("path")).groupBy("lang", "path").agg(F.count("*").alias("times"))
    # Ranges of beginnings: what Spark samples for their limits stays small, and deeper nodes have all their terms in one task.
    sorted_paths = paths.repartitionByRange("lang", F.slice("path", 1, BEGINNING)).sortWithinPartitions("lang", "path")
    together = sorted_paths.mapInArrow(_trees, "lang string, a int, b int, value long")
    # Terms that only one of two sources has, by the number of terms with the same share.
    alone = own.groupBy("lang", F.col("place").alias("x"), "p", F.col("none").alias("own")).agg(F.count("*").alias("m"))
    others = sources.select("lang", F.col("place").alias("y"), F.col("none").alias("other"))
    met = alone.join(others, "lang").filter("x <> y")
    out = met.select("lang", F.col("x").alias("a"), F.col("y").alias("b"), (F.col("m") * (distance(F.col("p"), F.col("other")) - distance(F.col("own"), F.col("other")))).alias("value"))
    back = met.select("lang", F.col("y").alias("a"), F.col("x").alias("b"), (F.col("m") * (distance(F.col("other"), F.col("p")) - distance(F.col("other"), F.col("own")))).alias("value"))
    summed = together.unionByName(out).unionByName(back).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = sources.select("lang", "source", "terms", F.col("place").alias("a"), F.col("none").alias("p"))
    two = sources.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("none").alias("q"))
    every = one.join(two, "lang").filter("a <> b").join(summed, ["lang", "a", "b"], "left")
    return every.select("lang", "source", "item", (F.col("terms") * distance(F.col("p"), F.col("q")) + F.coalesce("value", F.lit(0))).alias("value"))


def terms(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, item, value): each group's terms that it uses more than its language does, and by how much they diverge."""
    own = _entries(rows, sources).filter("p > q")
    return own.select("lang", "source", F.col("term").cast("string").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))


def _ranked(values: DataFrame, part: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return values.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), place.cast("int").alias("rank"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by divergence, and the TERMS_LISTED most divergent terms of each group.

    Null text, lang and source read as ''; each row is a document, repeated ones
    too; texts of any length are taken whole; a group without kept terms has pairs
    of value by the others' shares, or 0 if its language keeps none; ties go by the
    item's bytes; an empty table gives no rows; other columns are not read. Sums
    stay below 2^63, as the shares of a group add up to 1e9 + 2 V at most.
    """
    rows = materialise(term_rows(docs, text, lang, source), "term-rows")
    sources = materialise(groups(docs, rows, lang, source), "groups")
    best = _ranked(terms(rows, sources), "term").filter(F.col("rank") <= TERMS_LISTED)
    return _ranked(pairs(rows, sources), "pair").unionByName(best)
