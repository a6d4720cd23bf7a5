"""Hashed document terms for the learned filters."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_TABLE, WORD_TABLE, held_out, joined, prefix_hashes, quoted, span_hashes, spans, text_bytes, words


PREFIXES = (4, 5, 6, 7)  # bytes of a word that count as terms of their own
SAMPLE_BYTES = 64 << 10  # a longer text is not learned from
LEVELS = (1, 2, 4)  # a term that occurs that often counts as a further term


def bucketed(hashes: np.ndarray, first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the hashed words, rows ascending."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key, n = np.unique(row * buckets + (hashes % np.uint64(buckets)).astype(np.int64), return_counts=True)
    return key // buckets, key % buckets, n


def term_counts(rows: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the hashed lower-case words of each text."""
    h, first = words(rows, WORD_TABLE)
    return bucketed(h, first, buckets)


def stem_terms(rows: list[bytes], buckets: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of the words and word beginnings of each text, rows ascending.

    Term b + l * buckets says that bucket b occurs LEVELS[l] times or more.
    wanted: a flag per bucket; other buckets are left out early.
    """
    data, at = joined(rows)
    data = LOWER[data]
    s, e = spans(data, WORD_TABLE)
    row = np.searchsorted(at, s, "right") - 1
    keys = []
    for n, h in zip((0, *PREFIXES), [span_hashes(data, s, e), *prefix_hashes(data, s, e, PREFIXES)], strict=True):
        b = ((h + np.uint64(n)) % np.uint64(buckets)).astype(np.int64)
        ok = e - s > n
        if wanted is not None:
            ok &= wanted[b]
        keys.append(row[ok] * buckets + b[ok])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    out = np.concatenate([key[count >= n] // buckets * len(LEVELS) * buckets + key[count >= n] % buckets + k * buckets for k, n in enumerate(LEVELS)])
    out.sort()
    return out // (len(LEVELS) * buckets), out % (len(LEVELS) * buckets)


# Bytes to classes of characters; anything else stands for itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[b for b in range(256) if chr(b).islower() or b >= 128]] = ord("a")
_SHAPE[[b for b in range(128) if chr(b).isupper()]] = ord("A")
_SHAPE[[b for b in range(128) if chr(b).isdigit()]] = ord("0")


def shape_counts(rows: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the hashed shapes of each text's blank-separated tokens: runs of a class count once."""
    data, at = joined(rows)
    data = _SHAPE[data]
    keep = np.append(True, data[1:] != data[:-1])
    keep[at[:-1]] = True
    place = np.append(0, np.cumsum(keep))
    data = data[keep]
    s, e = spans(data, SPACE_TABLE)
    return bucketed(span_hashes(data, s, e), np.searchsorted(s, place[at]), buckets)


def style(rows: list[bytes]) -> np.ndarray:
    """Four figures of each text: words that repeat the word before, repeated words, repeated lines, word length."""
    out = np.zeros((len(rows), 4), np.float32)
    h, first = words(rows, WORD_TABLE)
    data, at = joined(rows)
    lines = np.ones(256, bool)
    lines[10] = False
    ls, le = spans(LOWER[data], lines)
    lh, lfirst = span_hashes(data, ls, le), np.searchsorted(ls, at)
    for k, r in enumerate(rows):
        n = first[k + 1] - first[k]
        if n:
            own = h[first[k] : first[k + 1]]
            out[k, 0] = 3 * (own[1:] == own[:-1]).sum() / n
            out[k, 1] = 1 - len(np.unique(own)) / n
            out[k, 3] = min(1.0, len(r) / n / 20)
        m = lfirst[k + 1] - lfirst[k]
        if m:
            out[k, 2] = 1 - len(np.unique(lh[lfirst[k] : lfirst[k + 1]])) / m
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `most` labelled training texts of `most_bytes` at most each, one per id, chosen by a hash of the id: i, y and t.

    Rows held out (crc32 of the id modulo 5 is 0) and null labels never enter.
    Where labels repeat an id, its highest label counts; where documents do, the
    least text. Longer texts are not learned from, so the sample is bounded in
    bytes as well; they are scored whole.
    """
    own = labels.select(F.col("doc_id").alias("i"), F.col(label).cast("int").alias("y"))
    own = own.filter(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out("i")).groupBy("i").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(quoted(id_col)).alias("i"), text_bytes(text_col).alias("t")).filter(F.length("t") <= most_bytes)
    chosen = texts.select("i").join(own, "i").distinct().orderBy(F.xxhash64("i"), "i").limit(most)
    return texts.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min("t").alias("t"))
