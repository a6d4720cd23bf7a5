"""Interpolated modified Kneser-Ney bigram model (operator 6).

Map tasks count the bigrams of their texts and send compact blobs to the buckets
of the left words; a bucket's task adds them up, writes the bucket's model file
and sends how many left words each right word follows to that word's bucket.
Left words that are very frequent are spread over several buckets, so no bucket
outgrows the others. Every pass splits what it holds into at most FAN blobs: up
to FAN buckets take one shuffle a side, FAN * FAN two, and so on, so the number
of blobs grows with the text and not with its square.

A model file holds the sorted 64-bit hash arrays of a span of buckets, with
parallel values, and a directory of them at its end. So the number of files does
not follow the buckets: up to FILES buckets have a file each, and then files hold
more of them, SPAN at most. Scoring workers map each file once into memory and
look a block's distinct bigrams up by binary search; only touched pages are read.
"""
from __future__ import annotations

import mmap
import os
import sys
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_TABLE, byte_rows, held_out, local_path, mix, row_blocks, scratch, task, text_bytes, words

BUCKET_BYTES = 12 << 20  # training text of a bucket
HOT_SHARE = 2_000  # a left word with a 2000th of the sampled words is spread
COUNT_BYTES = 16 << 20  # text whose bigrams are counted together
FAN = 256  # blobs that a pass makes of what it holds, at most
SPLIT_ENTRIES = 1 << 20  # entries that are split together
SPLIT_BYTES = 64 << 20  # training text of a splitting task
FILES = 128  # model files of a kind, while they hold fewer than SPAN buckets each
SPAN = 32  # buckets of a model file, at most
SCORE_BYTES = 4 << 20  # text whose bigrams are looked up together
BEGIN = np.uint64(0x0B0B0B0B0B0B0B0B)
END = np.uint64(0x0E0E0E0E0E0E0E0E)


def sequences(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, row) hashes of all bigrams: begin, the words, and the end, of each text."""
    h, first = words(rows, SPACE_TABLE)
    n = np.diff(first)
    at = np.cumsum(n + 1) - 1  # where each end stands
    right = np.empty(len(h) + len(rows), np.uint64)
    is_end = np.zeros(len(right), bool)
    is_end[at] = True
    right[is_end] = END
    right[~is_end] = h
    left = np.append(BEGIN, right[:-1])
    left[is_end.nonzero()[0][:-1] + 1] = BEGIN
    return left[: len(right)], right, np.repeat(np.arange(len(rows)), n + 1)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def left_bucket(left: np.ndarray, right: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a bigram: by its left word, or by both where the left word is hot."""
    by = left
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, left), len(hot) - 1)] == left
        by = np.where(is_hot, pair_hash(left, right), left)
    return bucket_of(by, n)


def add_up(keys: np.ndarray, counts: np.ndarray, *also: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, their summed counts, and the first of each other array."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order], first) if len(keys) else counts
    return (keys[first], total, *(a[order][first] for a in also))


def _small(counts: np.ndarray) -> bytes:
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", -1, n) if (out == 255).any() else 0
    return out


def to_blob(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> bytes:
    """Bigrams sorted by left word: distinct left words, how often each, right words, counts."""
    order = np.argsort(left, kind="stable")
    left, right, counts = left[order], right[order], counts[order]
    first = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
    runs = np.diff(np.append(first, len(left)))
    parts = [left[first].tobytes(), _small(runs), right.tobytes(), _small(counts)]
    head = np.array([len(first), len(left), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def from_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n_left, n, *sizes = np.frombuffer(data, "<i8", 6).tolist()
    cut = np.append(48, 48 + np.cumsum(sizes))
    a, b, c, d = (data[cut[k] : cut[k + 1]] for k in range(4))
    return np.repeat(np.frombuffer(a, np.uint64), _large(b, n_left)), np.frombuffer(c, np.uint64), _large(d, n)


def to_right(word: np.ndarray, lefts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(word)], "<i8").tobytes() + word.tobytes() + _small(lefts))


def from_right(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    return np.frombuffer(data, np.uint64, n, 8), _large(data[8 + 8 * n :], n)


def merge_left(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    _, counts, left, right = add_up(pair_hash(left, right), counts, left, right)
    return left, right, counts


def runs_of(b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct number and where it stands."""
    order = np.argsort(b, kind="stable")
    own, first = np.unique(b[order], return_index=True)
    if len(own):
        yield from zip(own.tolist(), np.split(order, first[1:]), strict=True)


@dataclass(frozen=True)
class Side:
    """How blobs of bigrams, or of right words, are read, added up, dealt and written."""

    unpack: Callable
    merge: Callable
    bucket: Callable
    pack: Callable

    def gathered(self, blobs) -> tuple[np.ndarray, ...]:
        return self.merge(*map(np.concatenate, zip(*map(self.unpack, blobs), strict=True)))

    def dealt(self, arrays: tuple[np.ndarray, ...], step: int) -> Iterator[tuple[int, bytes]]:
        """(number, blob) of each span of `step` buckets."""
        for k, i in runs_of(self.bucket(*arrays) // step):
            yield k, self.pack(*(a[i] for a in arrays))


def sides(buckets: int, hot: np.ndarray) -> tuple[Side, Side]:
    def by_left(left, right, counts):
        return left_bucket(left, right, hot, buckets)

    def by_word(word, lefts):
        return bucket_of(word, buckets)

    return Side(from_blob, merge_left, by_left, to_blob), Side(from_right, add_up, by_word, to_right)


def steps(buckets: int, fan: int = FAN) -> list[int]:
    """How many buckets a blob of each pass spans; the last spans one."""
    out = [1]
    while out[0] * fan < buckets:
        out.insert(0, out[0] * fan)
    return out


def span_of(buckets: int) -> int:
    """Buckets of a model file."""
    return min(SPAN, max(1, -(-buckets // FILES)))


class _Writer:
    """A model file, put in place whole when it is closed: a repeated task writes the same bytes."""

    def __init__(self, folder: str, kind: str, number: int) -> None:
        os.makedirs(folder, exist_ok=True)
        fd, self.temporary = tempfile.mkstemp(dir=folder, prefix=".")
        self.file, self.at, self.number = os.fdopen(fd, "wb"), [], number
        self.path = f"{folder}/{kind}-{number}"

    def add(self, bucket: int, arrays: dict[str, np.ndarray]) -> None:
        own = [bucket]
        for a in arrays.values():
            own += [self.file.tell(), len(a)]
            self.file.write(a.tobytes())
            self.file.write(bytes(-a.nbytes % 8))
        self.at.append(own)

    def close(self, whole: bool) -> None:
        if whole:
            self.file.write(np.array(self.at, "<i8").tobytes() + np.array([len(self.at)], "<i8").tobytes())
        self.file.close()
        if whole:
            os.replace(self.temporary, self.path)
        else:
            os.unlink(self.temporary)


_KINDS = {
    "left": {"pair": np.uint64, "count": np.uint8, "big": np.uint64, "big_count": np.int64, "word": np.uint64, "total": np.int64, "n1": np.int32, "n2": np.int32, "n3": np.int32},
    "right": {"word": np.uint64, "lefts": np.int32},
}


def _nothing(kind: str) -> dict[str, np.ndarray]:
    return {k: np.zeros(0, t) for k, t in _KINDS[kind].items()}


def _map(folder: str, kind: str, number: int) -> dict[int, dict[str, np.ndarray]]:
    """The arrays of a model file by bucket. The mapping holds no file descriptor where Python can do without."""
    path = f"{folder}/{kind}-{number}"
    if not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        how = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        data = np.frombuffer(mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ, **how), np.uint8)
    names = _KINDS[kind]
    n, wide = int(data[-8:].view("<i8")[0]), 1 + 2 * len(names)
    places = data[len(data) - 8 * (1 + n * wide) : -8].view("<i8").reshape(n, wide).tolist()
    take = lambda at, size, t: data[at : at + size * np.dtype(t).itemsize].view(t)
    return {own[0]: {k: take(own[1 + 2 * i], own[2 + 2 * i], t) for i, (k, t) in enumerate(names.items())} for own in places}


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and presence of each key."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's discounts from the numbers of n-grams seen 1 to 4 times; 0.5, 1, 1.5 where undefined."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    got = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(got, 1))


@dataclass
class Model:
    folder: str
    buckets: int
    hot: np.ndarray
    hot_stats: dict[str, np.ndarray]  # of hot left words: total, n1, n2, n3
    tokens: int  # N
    distinct: int  # V
    pairs: int  # distinct bigrams
    high: tuple[float, float, float]
    low: tuple[float, float, float]
    low_kinds: tuple[int, int, int]  # words that follow 1, 2, 3 or more left words


#: kind 0: a bucket's counts of counts, 1: of its hot left words, 2: right words on their way, 3: counts of those
META = "kind int, bucket int, word array<long>, n array<long>, blob binary"
WIDTH = 7  # numbers in `n` for each entry of `word`


def _line(kind: int, bucket: int, word: np.ndarray, n: np.ndarray) -> tuple:
    wide = np.zeros((len(word), WIDTH), np.int64)
    wide[:, : n.shape[1]] = n
    return kind, bucket, word.astype(np.int64), wide.ravel(), None


def _count(side: Side, step: int):
    """Texts to blobs of bigram counts by span of buckets."""

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        left, right = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        own, blobs = zip(*side.dealt(side.merge(left, right, np.ones(len(left), np.int64)), step), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, _, rows in row_blocks(batch.column(0)):
                parts.append(sequences(rows)[:2])
                size += sum(map(len, rows))
                if size >= COUNT_BYTES:
                    yield from flush(parts)
                    parts, size = [], 0
        yield from flush(parts)

    return run


def _split(side: Side, step: int):
    """Blobs of wide spans to blobs of narrower ones; rows without a blob pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            has = batch.column("blob").is_valid()
            yield batch.filter(pc.invert(has))
            batch = batch.filter(has)
            for k, own in runs_of(batch.column("bucket").to_numpy()):
                rows = batch.take(pa.array(own))
                held, size = [], 0
                for at, blob in enumerate(rows.column("blob")):
                    held.append(blob.as_py())
                    size += len(held[-1]) // 8
                    if size < SPLIT_ENTRIES and at + 1 < len(rows):
                        continue
                    got = list(side.dealt(side.gathered(held), step))
                    held, size = [], 0
                    new = {"bucket": pa.array([b for b, _ in got], pa.int32()), "blob": pa.array([x for _, x in got], pa.binary())}
                    if "kind" in names:
                        new["kind"] = pa.array([2] * len(got), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [new[c] if c in new else pa.nulls(len(got), batch.schema.field(c).type) for c in names], names
                    )

    return run


def narrowed(blobs: DataFrame, side: Side, spans: list[int], bucket_bytes: int) -> DataFrame:
    """Blobs of the first span split, pass by pass, into those of single buckets."""
    for wide, step in zip(spans, spans[1:], strict=False):
        parts = max(1, wide * bucket_bytes // SPLIT_BYTES)
        salt = F.pmod(F.xxhash64("blob"), F.lit(parts))
        dealt = blobs.repartition(F.col("bucket"), salt).sortWithinPartitions("bucket")
        blobs = dealt.mapInArrow(task(_split(side, step)), blobs.schema)
    return blobs


def _filed(folder: str, kind: str, span: int, make: Callable):
    """Rows sorted by bucket to model files: make(bucket, blobs) gives a bucket's arrays and lines. Rows without a blob pass through."""

    def lines(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "bucket", "word", "n", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, bucket, held = None, None, []

        def done() -> list[tuple]:
            nonlocal writer
            arrays, out = make(bucket, held)
            held.clear()
            if writer is None or writer.number != bucket // span:
                if writer is not None:
                    writer.close(True)
                writer = _Writer(folder, kind, bucket // span)
            writer.add(bucket, arrays)
            return out

        try:
            for batch in batches:
                if "kind" in batch.schema.names:
                    has = batch.column("blob").is_valid()
                    yield batch.filter(pc.invert(has))
                    batch = batch.filter(has)
                for own, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                    if held and own != bucket:
                        yield from lines(done())
                    bucket = own
                    held.append(blob.as_py())
            if held:
                yield from lines(done())
            if writer is not None:
                writer.close(True)
                writer = None
        finally:
            if writer is not None:
                writer.close(False)

    return run


def _reduce(here: Side, there: Side, hot: np.ndarray, step: int):
    """A bucket's bigrams: its arrays, statistics, and right words for the next shuffle."""

    def make(bucket: int, blobs: list[bytes]) -> tuple[dict[str, np.ndarray], list[tuple]]:
        left, right, counts = here.gathered(blobs)
        pair = pair_hash(left, right)  # merged in the order of these
        big = counts >= 255
        word, inverse = np.unique(left, return_inverse=True)
        total = np.bincount(inverse, counts, len(word)).astype(np.int64)
        n = [np.bincount(inverse[m], minlength=len(word)).astype(np.int64) for m in (counts == 1, counts == 2, counts >= 3)]
        is_hot = np.isin(word, hot)
        cold = ~is_hot
        arrays = {
            "pair": pair, "count": np.minimum(counts, 255).astype(np.uint8), "big": pair[big], "big_count": counts[big],
            "word": word[cold], "total": total[cold], **{f"n{k + 1}": n[k][cold].astype(np.int32) for k in range(3)},
        }
        own = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(pair), int(total[cold].sum())]
        out = [_line(0, bucket, np.zeros(1), np.array([own])), _line(1, bucket, word[is_hot], np.stack([total, *n], 1)[is_hot])]
        seen, lefts = np.unique(right, return_counts=True)
        return arrays, out + [(2, k, None, None, blob) for k, blob in there.dealt((seen, lefts), step)]

    return make


def _gather(side: Side):
    """Right words of a bucket: how many left words each follows, and statistics."""

    def make(bucket: int, blobs: list[bytes]) -> tuple[dict[str, np.ndarray], list[tuple]]:
        word, lefts = side.gathered(blobs)
        n = [int((lefts == k).sum()) for k in (1, 2, 3, 4)] + [int((lefts >= 3).sum()), len(word), int(lefts.sum())]
        return {"word": word, "lefts": lefts.astype(np.int32)}, [_line(3, bucket, np.zeros(1), np.array([n]))]

    return make


def hot_words(texts: DataFrame) -> np.ndarray:
    """Left words with a large share of a sample, at most HOT_SHARE; any set gives the same model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, _, _ = sequences(byte_rows(batch.column(0)))
            word, n = np.unique(left, return_counts=True)
            top = n * HOT_SHARE >= len(left)
            words_ = pa.array([*word[top].astype(np.int64).tolist(), None], pa.int64())
            yield pa.RecordBatch.from_arrays([words_, pa.array([*n[top].tolist(), len(left)], pa.int64())], ["word", "n"])

    got = texts.sample(0.02, seed=7).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = got.orderBy(F.desc("n"), "word").limit(HOT_SHARE + 1).collect()  # the sample's size, without a word, is the first
    return np.unique(np.array([BEGIN, *(np.int64(r.word).astype(np.uint64) for r in top if r.word is not None and r.n * HOT_SHARE >= top[0].n)], np.uint64))


def train(texts: DataFrame, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> Model:
    """Counts the model of the binary column `t` into files of the shared folder."""
    folder = local_path(scratch(texts.sparkSession, "kneser"))
    size = texts.agg(F.sum(F.length("t") + 1)).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    hot = hot_words(texts)
    here, there = sides(buckets, hot)
    spans = steps(buckets, fan)
    blobs = texts.mapInArrow(task(_count(here, spans[0])), "bucket int, blob binary")
    span = span_of(buckets)

    def filed(blobs: DataFrame, kind: str, make: Callable) -> DataFrame:
        dealt = blobs.repartition(F.floor(F.col("bucket") / span)).sortWithinPartitions("bucket")
        return dealt.mapInArrow(task(_filed(folder, kind, span, make)), META)

    rows = filed(narrowed(blobs, here, spans, bucket_bytes), "left", _reduce(here, there, hot, spans[0]))
    lines = filed(narrowed(rows, there, spans, bucket_bytes), "right", _gather(there))
    lines = lines.filter(F.col("word").isNotNull()).select("kind", "n", F.posexplode("word").alias("i", "word"))
    sums = lines.groupBy("kind", "word").agg(*[F.sum(F.col("n")[F.col("i") * WIDTH + k]).alias(f"n{k}") for k in range(WIDTH)])
    got = {(r.kind, r.word): list(r[2:]) for r in sums.collect()}  # at most HOT_SHARE words and two lines
    high, low = (got.get((kind, 0), [0] * WIDTH) for kind in (0, 3))
    stats = {w: n[:4] for (kind, w), n in got.items() if kind == 1}
    words_ = np.array(sorted(np.int64(w).astype(np.uint64) for w in stats), np.uint64)
    cols = np.array([stats[int(w.astype(np.int64))] for w in words_], np.int64).reshape(-1, 4)
    ends = sum(stats.get(int(BEGIN.astype(np.int64)), [0])[:1])  # texts: each has one begin and one end
    # every token but an end is some bigram's left word, so the left totals without the begins, and the ends, are all tokens
    return Model(folder, buckets, hot, {"word": words_, "total": cols[:, 0], "n1": cols[:, 1], "n2": cols[:, 2], "n3": cols[:, 3]},
                 high[5] + int(cols[words_ != BEGIN, 0].sum()) + ends, low[5], high[4], discounts(high[:4]), discounts(low[:4]), (low[0], low[1], low[4]))


class _Files:
    """A model's arrays of one kind by bucket; each file is mapped once."""

    def __init__(self, model: Model, kind: str) -> None:
        self.folder, self.kind, self.span = model.folder, kind, span_of(model.buckets)
        self.files: dict[int, dict[int, dict[str, np.ndarray]]] = {}

    def __getitem__(self, bucket: int) -> dict[str, np.ndarray]:
        number = bucket // self.span
        if number not in self.files:
            self.files[number] = _map(self.folder, self.kind, number)
        return self.files[number].get(bucket) or _nothing(self.kind)


class Scorer:
    """Looks bigrams up in the files, each mapped when it is first needed."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.left, self.right = (_Files(model, kind) for kind in _KINDS)

    def lefts(self, word: np.ndarray) -> np.ndarray:
        """How many distinct left words each word follows."""
        out = np.zeros(len(word), np.int64)
        for k, i in runs_of(bucket_of(word, self.m.buckets)):
            at, ok = _find(self.right[k]["word"], word[i])
            out[i[ok]] = self.right[k]["lefts"][at[ok]]
        return out

    def context(self, word: np.ndarray) -> np.ndarray:
        """Total count and numbers of right words seen 1, 2, 3 or more times, per left word."""
        out = np.zeros((len(word), 4), np.int64)
        names = ("total", "n1", "n2", "n3")
        at, ok = _find(self.m.hot_stats["word"], word)
        for c, k in enumerate(names):
            out[ok, c] = self.m.hot_stats[k][at[ok]] if ok.any() else 0
        rest = np.flatnonzero(~ok)
        for b, i in runs_of(bucket_of(word[rest], self.m.buckets)):
            at, ok = _find(self.left[b]["word"], word[rest[i]])
            for c, k in enumerate(names):
                out[rest[i[ok]], c] = self.left[b][k][at[ok]]
        return out

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out, key = np.zeros(len(left), np.int64), pair_hash(left, right)
        for b, i in runs_of(left_bucket(left, right, self.m.hot, self.m.buckets)):
            own = self.left[b]
            at, ok = _find(own["pair"], key[i])
            out[i[ok]] = own["count"][at[ok]]
            big = i[ok][out[i[ok]] == 255]
            if len(big):
                out[big] = own["big_count"][_find(own["big"], key[big])[0]]
        return out

    def log10(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model's log10 probability of each bigram, and the training count of its right word."""
        m = self.m
        words_, back = np.unique(np.concatenate((left, right)), return_inverse=True)
        lefts, ctx = self.lefts(words_), self.context(words_)
        ends = m.hot_stats["total"][m.hot_stats["word"] == BEGIN]
        token_count = np.where(words_ == END, ends.sum(), ctx[:, 0])
        d = np.array((0.0, *m.low))
        if m.pairs:
            rest = (d[1] * m.low_kinds[0] + d[2] * m.low_kinds[1] + d[3] * m.low_kinds[2]) / m.pairs
            low = np.maximum(lefts - d[np.minimum(lefts, 3)], 0) / m.pairs + rest / (m.distinct + 1)
        else:
            low = np.ones(len(words_))
        n_left = len(left)
        ctx, low, seen = ctx[back[:n_left]], low[back[n_left:]], token_count[back[n_left:]]
        c = self.pairs(left, right)
        d = np.array((0.0, *m.high))
        known = ctx[:, 0] > 0
        total = np.where(known, ctx[:, 0], 1)
        spare = np.where(known, (d[1] * ctx[:, 1] + d[2] * ctx[:, 2] + d[3] * ctx[:, 3]) / total, 1.0)
        return np.log10(np.maximum(c - d[np.minimum(c, 3)], 0) / total + spare * low), seen


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text with a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        m = shared.value
        for batch in batches:
            for i, j, rows in row_blocks(batch.column(1), SCORE_BYTES):
                left, right, row = sequences(rows)
                _, first, back = np.unique(pair_hash(left, right), return_index=True, return_inverse=True)
                p, seen = scorer.log10(left[first], right[first])
                base = np.log10((seen + 1) / (m.tokens + m.distinct + 1))
                n = j - i
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, n), pa.array(np.bincount(row, minlength=n), pa.int64()),
                    pa.array(np.bincount(row, seen[back] > 0, n).astype(np.int64)), pa.array(np.full(n, m.tokens, np.int64)),
                    pa.array(np.bincount(row, base[back], n)), pa.array(np.bincount(row, p[back], n)),
                ], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t"))
    return rows.mapInArrow(task(run), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexities(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Trains on the rows that aren't held out and scores all rows.

    Null and empty texts are an end alone; very long texts are counted and scored
    whole, in a block of their own; a null id is never held out; repeated
    rows are counted and scored as often as they occur; other columns are
    ignored; an empty table gives no rows; without training rows every word has
    the probability 1 / (V + 1) of an unseen word, V being 0.
    """
    ho = held_out("doc_id", modulus, remainder)
    model = train(docs.filter(~ho).select(text_bytes().alias("t")))
    got = score(docs, model)
    return got.select("doc_id", ho.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
