"""Quality by nearest-neighbour voting among labelled latent-semantic vectors (operator 3).

Texts become tf-idf vectors of hashed words and token shapes, projected on the
leading singular vectors of a bounded labelled sample. The sample's vectors are
broadcast (a fixed bound: SAMPLE_ROWS x RANK floats); every text's cosines with
all of them are computed in blocks, exactly, and its nearest neighbours vote
with their similarity.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_rows, held_out, quoted, row_blocks, schema_of, task, text_bytes, whole_row
from .features import bucketed, labelled_sample, shape_counts, style, term_counts  # noqa: F401

SAMPLE_ROWS = 6_000  # labelled rows whose vectors vote, at most
WORD_BUCKETS = 2_048
SHAPE_BUCKETS = 2_048
RANK = 48
NEIGHBOURS = 25
BLOCK_ROWS = 512
STYLE_WEIGHT = 0.5  # of the four style figures against a unit latent vector
WORD_WEIGHT = 0.4  # of words against shapes


@dataclass
class Space:
    idf: np.ndarray
    axes: np.ndarray  # (terms, rank)
    vectors: np.ndarray  # (sample, rank + 4), unit rows
    labels: np.ndarray
    prior: float

    def project(self, rows: list[bytes]) -> np.ndarray:
        z = _unit(_unit(tfidf(rows, self.idf)) @ self.axes)
        return _unit(np.concatenate([z, STYLE_WEIGHT * style(rows)], 1))

    def vote(self, rows: list[bytes], k: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        sim = self.project(rows) @ self.vectors.T
        k = min(k, sim.shape[1])
        least = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k, None]
        chosen = sim > least
        tied = sim == least  # as many of these as are still wanted, the first ones
        chosen |= tied & (np.cumsum(tied, 1) <= k - chosen.sum(1, keepdims=True))
        near = np.nonzero(chosen)[1].reshape(len(rows), k)
        w = np.maximum(np.take_along_axis(sim, near, 1), 0).astype(float) ** 4 + 1e-12
        return (w * self.labels[near]).sum(1) / w.sum(1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def counts(rows: list[bytes]) -> np.ndarray:
    """Damped term counts: words, then shapes."""
    out = np.zeros((len(rows), WORD_BUCKETS + SHAPE_BUCKETS), np.float32)
    r, b, n = term_counts(rows, WORD_BUCKETS)
    out[r, b] = WORD_WEIGHT * np.log1p(n)
    r, b, n = shape_counts(rows, SHAPE_BUCKETS)
    out[r, WORD_BUCKETS + b] = np.log1p(n)
    return out


def tfidf(rows: list[bytes], idf: np.ndarray) -> np.ndarray:
    return counts(rows) * idf


def fit(texts: list[bytes], y: np.ndarray, rank: int = RANK, seed: int = 7) -> Space:
    terms = WORD_BUCKETS + SHAPE_BUCKETS
    if not len(y):
        return Space(np.ones(terms, np.float32), np.zeros((terms, rank), np.float32), np.zeros((0, rank + 4), np.float32), np.zeros(0), 0.5)
    x = np.concatenate([counts(texts[i:j]) for i, j in blocks(np.array([len(t) for t in texts]))])
    idf = (np.log((1 + len(y)) / (1 + (x > 0).sum(0))) + 0.1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    rng = np.random.default_rng(seed)
    basis = rng.normal(size=(terms, rank + 16)).astype(np.float32)
    for _ in range(4):  # subspace iteration towards the leading right singular vectors
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    space = Space(idf, np.ascontiguousarray((basis @ vt.T)[:, :rank], np.float32), np.zeros((0, 0)), y, float(y.mean()))
    latent = _unit(x @ space.axes)
    del x
    figures = np.concatenate([style(texts[i:j]) for i, j in blocks(np.array([len(t) for t in texts]))])
    space.vectors = _unit(np.concatenate([latent, STYLE_WEIGHT * figures], 1)).astype(np.float32)
    return space


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Space:
    """The space of a bounded sample, computed in one task from the sample's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        rows: list[tuple] = []
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_rows(batch.column(2)), strict=True)
        rows.sort(key=lambda r: r[0])
        space = fit([r[2] for r in rows], np.array([min(max(r[1], 0), 1) for r in rows], float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(space)], pa.binary())], ["space"])

    import pickle

    sample = labelled_sample(docs, labels, "quality", sample_rows).repartition(1)  # bounded in rows and bytes
    got = sample.mapInArrow(task(run), "space binary").collect()
    return pickle.loads(got[0].space) if got else fit([], np.zeros(0))


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id and score of every whole text, or, if `whole`, the documents as one column `row` and the score."""
    model = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, rows in row_blocks(batch.column(0)):
                for a in range(i, j, BLOCK_ROWS):
                    b = min(j, a + BLOCK_ROWS)
                    part = batch.slice(a, b - a)
                    votes = model.value.vote(rows[a - i : b - i])
                    yield pa.RecordBatch.from_arrays([part.column(1), pa.array(votes, pa.float64())], [part.schema.names[1], "score"])

    first = whole_row(docs).alias("row") if whole else F.col(quoted(id_col)).alias("doc_id")
    rows = docs.select(text_bytes(text_col).alias("t"), first)
    return rows.mapInArrow(task(run), schema_of(rows, rows.columns[1], "score double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row.

    A null or empty text votes like any other (its vector is zero: every
    neighbour weighs the same); very long texts are scored whole; of neighbours
    of equal similarity the one that comes first by id votes; without usable
    labels every score is 0.5; a null id is scored, and neither held out nor
    learned from; repeated rows score alike, and a repeated id is learned from
    once; other columns are ignored; an empty table gives no rows.
    """
    got = score(docs, train(docs, labels, sample_rows))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
