"""Exact top-k search by inner product with ball trees (operator 8).

Rows are dealt into cells by the nearest of a bounded number of pivots, and large
cells into shards by a hash of the id; every shard builds a ball tree. A query
first searches its home shard; with the kth score found there it is sent only to
cells whose own ball, around the pivot, can reach that score, and their trees
skip every ball whose upper bound q.c + |q| r is below it. Balls are visited in
order of that bound. Queries go in blocks, so a task holds one shard and one
block, whatever the table's size, and rows go only where a block needs them.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, task

SHARD_ROWS = 8_192
BLOCK_QUERIES = 4_096
LEAF_ROWS = 64
SCALE = 256
PIVOTS = 1_024  # cells at most, for each length of vectors
PIVOT_BYTES = 16 << 20
SLICE = 1 << 20  # components taken at once


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Not null, and no component null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    a, b = int(np.abs(q).max()), int(np.abs(x).max())
    if a * b * q.shape[1] < 1 << 53:
        return np.rint(q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return (q.astype(object) @ x.T.astype(object)).astype(np.int64)


class BallTree:
    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        order = np.lexsort((ids, *x.T)) if len(x) else np.zeros(0, np.int64)
        ids, x = ids[order], x[order]
        if len(x):  # of equal vectors only the k+1 smallest ids can be in a result
            new = np.append(True, (x[1:] != x[:-1]).any(1))
            at = np.arange(len(x))
            keep = at - np.maximum.accumulate(np.where(new, at, 0)) <= k
            ids, x = ids[keep], x[keep]
        self.ids, self.x = ids, x
        self.nodes: list[tuple] = []
        if len(x):
            self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray) -> int:
        pts = self.x[rows].astype(np.float64)
        centre = pts.mean(0)
        far = np.sqrt(((pts - centre) ** 2).sum(1))
        me = len(self.nodes)
        self.nodes.append(())
        left = right = -1
        if len(rows) > LEAF_ROWS and far.max() > 0:
            a = pts[far.argmax()]
            b = pts[((pts - a) ** 2).sum(1).argmax()]
            side = (pts - centre) @ (a - b)
            order = np.argsort(side, kind="stable")
            half = len(rows) // 2
            left, right = self._build(rows[order[:half]]), self._build(rows[order[half:]])
        self.nodes[me] = (centre, float(far.max()), left, right, rows)
        return me

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's best k at or above its floor; id -1: none."""
        none = np.iinfo(np.int64).min
        score, ids = np.full((len(q), k), none), np.full((len(q), k), -1, np.int64)
        qf = q.astype(np.float64)
        length = np.sqrt((qf**2).sum(1))
        if not self.nodes or not len(q):
            return score, ids
        slack = 1e-6 + 1e-9 * length * max(float(np.abs(self.x).max()), 1) * q.shape[1]

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[node][:2]
            return qf[rows] @ centre + length[rows] * radius + slack[rows]

        def live(node: int, rows: np.ndarray) -> np.ndarray:
            return rows[bound(node, rows) >= np.maximum(floor[rows], score[rows, -1])]

        todo = [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            rows = live(node, rows)
            if not len(rows):
                continue
            _, _, left, right, own = self.nodes[node]
            if left >= 0:
                first = bound(left, rows) >= bound(right, rows)
                # taken from the end: for each query the ball of the higher bound comes first
                todo += [(right, rows[first]), (left, rows[first]), (left, rows[~first]), (right, rows[~first])]
                continue
            s = products(q[rows], self.x[own])
            s[query_ids[rows][:, None] == self.ids[own][None, :]] = none
            s[s < floor[rows][:, None]] = none
            better = s.max(1) >= score[rows, -1]
            rows, s = rows[better], s[better]
            if len(rows):
                both = np.concatenate((score[rows], s), 1)
                who = np.concatenate((ids[rows], np.broadcast_to(self.ids[own], s.shape)), 1)
                best = np.lexsort((who, -both.astype(np.float64) if np.abs(both[both != none]).max(initial=0) < 1 << 53 else _ranks(both)), axis=-1)[:, :k]
                score[rows] = np.take_along_axis(both, best, 1)
                ids[rows] = np.where(score[rows] == none, -1, np.take_along_axis(who, best, 1))
        return score, ids


def _ranks(a: np.ndarray) -> np.ndarray:
    """Dense descending ranks, for scores beyond the exact range of doubles."""
    values = np.unique(a)
    return len(values) - np.searchsorted(values, a)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), -1)


def _searcher(k: int, final: bool):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "q", "floor"] if not final else ["query_id", "vec_id", "score"]
        if not len(queries):
            kinds = {"q": object}
            return pd.DataFrame({n: pd.Series(dtype=kinds.get(n, np.int64)) for n in names})
        x = _matrix(rows["v"]) if len(rows) else np.zeros((0, len(queries["q"].iloc[0])), np.int64)
        qid, q = queries["query_id"].to_numpy(np.int64), _matrix(queries["q"])
        floor = queries["floor"].to_numpy(np.int64)
        tree = BallTree(rows["vec_id"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64), x, k)
        score, ids = tree.search(qid, q, k, floor)
        if not final:
            return pd.DataFrame({"query_id": qid, "q": queries["q"].tolist(), "floor": np.where(ids[:, -1] >= 0, score[:, -1], floor)})
        at, rank = np.nonzero(ids >= 0)
        return pd.DataFrame({"query_id": qid[at], "vec_id": ids[at, rank], "score": score[at, rank]})

    return run


def _slices(batch: pa.RecordBatch, column: str):
    """(row numbers, matrix) of the vectors of one length, some at a time."""
    lists = batch.column(column)
    flat, first = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    length = np.diff(first)
    for dim in np.unique(length):
        own = np.flatnonzero(length == dim)
        for part in np.array_split(own, -(-len(own) * int(dim) // SLICE)):
            yield part, flat[first[part][:, None] + np.arange(dim)].astype(np.float64)


def _assign(pivots: dict[int, np.ndarray]):
    """Each vector's nearest pivot and the distance; -1 where no pivot has its length."""

    def run(batches):
        for batch in batches:
            cell, far = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            for own, x in _slices(batch, "v"):
                if (p := pivots.get(x.shape[1])) is not None:
                    cell[own] = ((p**2).sum(1) - 2 * x @ p.T).argmin(1)
                    far[own] = np.sqrt(((x - p[cell[own]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return run


def _route(pivots: dict[int, np.ndarray], radius: dict[int, np.ndarray]):
    """Each query once for every cell that can hold a score at or above its floor."""

    def run(batches):
        for batch in batches:
            floor = batch.column("floor").to_numpy()
            for own, q in _slices(batch, "q"):
                dim = q.shape[1]
                if dim in pivots:
                    p, r = pivots[dim], radius[dim]
                    length = np.sqrt((q**2).sum(1))[:, None]
                    reach = np.sqrt((p**2).sum(1)) + r
                    bound = q @ p.T + length * r + 1e-6 + 1e-9 * dim * length * (reach + 1)
                    at, cell = np.nonzero((bound >= floor[own][:, None]) & (r >= 0))
                else:
                    at, cell = np.arange(len(own)), np.full(len(own), -1)
                sent = batch.take(pa.array(own[at]))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    return run


def _cells(rows: DataFrame, shard_rows: int, total: int, widest: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Rows with cell and distance, written, and the pivots: vectors of least id hash, one a shard up to the bounds."""
    n = max(1, min(-(-total // shard_rows), PIVOTS, PIVOT_BYTES // (8 * max(widest, 1))))
    picked = rows.select("v").orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(n).collect()
    by_dim: dict[int, list] = {}
    for r in picked:
        by_dim.setdefault(len(r.v), []).append(r.v)
    pivots = {dim: np.unique(np.array(v, np.float64), axis=0) for dim, v in by_dim.items()}
    return materialise(rows.mapInArrow(task(_assign(pivots)), "vec_id long, v array<long>, dim int, cell int, far double"), "top-k-cells"), pivots


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Each query's k best rows: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by `every`; a query's candidates
    are all rows of other ids. Unusable or empty vectors and null ids take no part;
    vectors of another length than the query's are no candidates; ties go to
    the smaller id; rows of one id count each. Other columns are ignored; an empty
    table, or one without queries, gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("e")) & (F.size("e") > 0)).select("vec_id", quantised(F.col("e")).alias("v"), F.size("e").alias("dim"))
    total, widest = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    n_blocks = max(1, -(-total // (every * block_queries)))
    rows, pivots = _cells(rows, shard_rows, total, widest)
    cells = materialise(rows.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")), "top-k-balls")
    radius = {dim: np.full(len(p), -1.0) for dim, p in pivots.items()}
    for r in cells.filter("cell >= 0").collect():  # at most one a pivot
        radius[r.dim][r.cell] = r.far
    shard = ["dim", "cell", "part"]
    rows = rows.join(cells.select("dim", "cell", "parts"), ["dim", "cell"]).select("vec_id", "v", "dim", "cell", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"))
    queries = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), *[F.col(c).alias(c) for c in shard], F.lit(-(2**63)).alias("floor"))
    home = queries.groupBy(*shard).cogroup(rows.groupBy(*shard)).applyInPandas(_searcher(k, False), "query_id long, q array<long>, floor long")
    home = materialise(home, "top-k-floors")
    sent = home.mapInArrow(task(_route(pivots, radius)), "query_id long, q array<long>, floor long, cell int")
    sent = sent.withColumn("dim", F.size("q")).withColumn("block", F.pmod(F.xxhash64(F.lit(7), "query_id"), F.lit(n_blocks)).cast("int"))
    each = sent.join(cells.select("dim", "cell", "parts"), ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    needed = sent.groupBy("dim", "cell").agg(F.collect_set("block").alias("blocks"))  # n_blocks numbers at most
    held = rows.join(needed, ["dim", "cell"]).withColumn("block", F.explode("blocks")).drop("blocks")
    each = each.select(*[F.col(c).alias(c) for c in each.columns])  # columns of its own, as both sides come from `cells`
    found = each.groupBy(*shard, "block").cogroup(held.groupBy(*shard, "block")).applyInPandas(_searcher(k, True), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
