"""Toxicity by a factorization machine over hashed terms (operator 2).

score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of
a text: its words, the beginnings of its words, and how often they occur. The pairwise part learns terms that matter together, such as an insult
with a mention of a group. The machine is fitted on a bounded sample of labelled
rows; scoring covers every whole text.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, quoted, row_blocks, schema_of, task, text_bytes, whole_row
from .features import LEVELS, labelled_sample, stem_terms

SAMPLE_ROWS = 6_000  # labelled rows fitted on, at most
BUCKETS = 1 << 18  # hashed terms
KEPT_TERMS = 2_048  # terms with the strongest association in the sample
FACTORS = 8
EPOCHS = 30


@dataclass
class Machine:
    bias: float
    buckets: np.ndarray  # ascending
    weight: np.ndarray
    factor: np.ndarray

    def score(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts from the (row, bucket) of their terms."""
        at = np.minimum(np.searchsorted(self.buckets, bucket), max(len(self.buckets) - 1, 0))
        ok = self.buckets[at] == bucket if len(self.buckets) else np.zeros(len(bucket), bool)
        return _sigmoid(self._raw(row[ok], at[ok], n))

    def _raw(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(row, self.weight[term], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[term, f]
            z += (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n)) / 2
        return z


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def choose(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, most: int, buckets: int) -> np.ndarray:
    """Buckets whose presence goes most with the label, by a chi-squared statistic."""
    n, pos = len(y), y.sum()
    seen = np.bincount(bucket, minlength=buckets).astype(float)
    hit = np.bincount(bucket, y[row], buckets)
    want = seen * pos / max(n, 1)
    chi = (hit - want) ** 2 / np.maximum(want * (1 - seen / max(n, 1)) * (1 - pos / max(n, 1)), 1e-9)
    chi[(seen < 3) | (seen == n)] = 0
    top = np.argsort(-chi, kind="stable")[:most]
    return np.sort(top[chi[top] > 0])


def fit(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, buckets: int = len(LEVELS) * BUCKETS, most: int = KEPT_TERMS, factors: int = FACTORS, epochs: int = EPOCHS, l2: float = 1e-4, rate: float = 0.1, seed: int = 7) -> Machine:
    """Adagrad on the log loss over mini-batches of whole texts."""
    n, pos = len(y), float(y.sum())
    start = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    kept = choose(row, bucket, y, most, buckets)
    if not len(kept):
        return Machine(start, kept, np.zeros(0), np.zeros((0, factors)))
    rng = np.random.default_rng(seed)
    at = np.searchsorted(kept, bucket)
    ok = kept[np.minimum(at, len(kept) - 1)] == bucket
    row, term = row[ok], at[ok]
    first = np.searchsorted(row, np.arange(n + 1))
    m = Machine(start, kept, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), factors)))
    gw, gv, gb = np.full(len(kept), 1e-6), np.full((len(kept), factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            own = order[i : i + 256]
            size = first[own + 1] - first[own]
            r = np.repeat(np.arange(len(own)), size)
            t = term[np.repeat(first[own] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]
            g = (_sigmoid(m._raw(r, t, len(own))) - y[own]) / len(own)
            d = np.bincount(t, g[r], len(kept)) + l2 * m.weight
            gw += d * d
            m.weight -= rate * d / np.sqrt(gw)
            for f in range(factors):
                v = m.factor[:, f]
                total = np.bincount(r, v[t], len(own))
                d = np.bincount(t, g[r] * (total[r] - v[t]), len(kept)) + l2 * v
                gv[:, f] += d * d
                m.factor[:, f] = v - rate * d / np.sqrt(gv[:, f])
            gb += g.sum() ** 2
            m.bias -= rate * g.sum() / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> Machine:
    """Fits on a bounded sample; only the sample's hashed terms reach the driver."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, rows in row_blocks(batch.column(2)):
                row, bucket = stem_terms(rows, buckets)
                first = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(bucket, pa.int32()))],
                    ["i", "y", "terms"],
                )

    sample = labelled_sample(docs, labels, "toxic", sample_rows)
    kind = sample.schema["i"].dataType.simpleString()
    got = sample.mapInArrow(task(terms), f"i {kind}, y int, terms array<int>").toArrow().sort_by([("i", "ascending")]).combine_chunks()
    lists = got.column("terms").combine_chunks()
    bucket = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    return fit(row, bucket, got.column("y").to_numpy().astype(float).clip(0, 1), len(LEVELS) * buckets)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """doc_id and score of every whole text, or, if `whole`, the documents as one column `row` and the score."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(buckets, bool)
        wanted[model.value.buckets % buckets] = True
        for batch in batches:
            for i, j, rows in row_blocks(batch.column(0)):
                row, bucket = stem_terms(rows, buckets, wanted)
                p = model.value.score(row, bucket, j - i)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(p)], [part.schema.names[1], "score"])

    first = whole_row(docs).alias("row") if whole else F.col(quoted(id_col)).alias("doc_id")
    rows = docs.select(text_bytes(text_col).alias("t"), first)
    return rows.mapInArrow(task(run), schema_of(rows, rows.columns[1], "score double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row.

    Null and empty texts get the score of a text without terms; very long texts
    are scored whole; without usable labels every score is 0.5; a null id is
    scored, and neither held out nor learned from; repeated rows score alike, and
    a repeated id is learned from once; other columns are ignored; an empty table
    gives no rows.
    """
    got = score(docs, train(docs, labels, sample_rows))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
