"""Texts longer than the blocks in which operators 1, 4, 7, 9 and 10 work, and a passage that very many share."""
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from lettermill.llm import bpe, packing, planes, repeats, webp

LONG = " ".join(f"word{(i * 7919) % 4001} été {'x' * (i % 13)}!" for i in range(230_000))


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG.encode()) > 5_000_000
    return spark.createDataFrame([(1, "short"), (2, LONG), (3, None), (4, "end")], "doc_id long, text string").repartition(2).cache()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_bpe(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ids = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={}).encode_ordinary(LONG)
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert got[2].n_tokens == len(ids) and got[2].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[2].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()


def test_packing(docs):
    ids = [*Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(LONG, add_special_tokens=False).ids, 0]
    own = sorted((r.start, r.length, r.ids_crc32) for r in packing.pack_documents(docs).filter("doc_id = 2").collect())
    assert sum(n for _, n, _ in own) == len(ids) and all(c == crc(ids[a : a + n]) for a, n, c in own)


def test_token_files(docs):
    ids = [*Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(LONG, add_special_tokens=False).ids, 1]
    got = {r.doc_id: r for r in planes.round_trip(docs).collect()}
    assert (got[2].n_tokens, got[2].ids_crc32) == (len(ids), crc(ids)) and got[3].start == got[2].start + len(ids)


def test_media(docs):
    data = LONG.encode()
    data += bytes(-len(data) % 64)
    got = {r.doc_id: r for r in webp.media_round_trip(docs).collect()}
    assert got[2].payload_sha256 == hashlib.sha256(data).hexdigest() and got[2].payload_bytes == len(data)


@pytest.mark.parametrize("words,sizes", [(90, {16, 4, 2}), (57, {16, 4, 2, 1})])
def test_hot_passage(spark, monkeypatch, words, sizes):
    """Many texts hold one passage and differ all around it: its pieces are sorted in runs, single strings only next to its ends."""
    rng, used, parts = random.Random(6), set(), repeats._parts
    monkeypatch.setattr(repeats, "_parts", lambda length, size: (used.add(size), parts(length, size))[1])
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(n))
    passage = " ".join(f"hot{i:03d}" for i in range(words))
    texts = [noise(500) + passage + noise(500) for _ in range(900)]
    seen = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removals(docs, group=300).collect()}
    for i, t in enumerate(texts):
        cover = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                cover[k : k + 400] = True
        kept = np.frombuffer(t.encode(), np.uint8)[~cover].tobytes()
        assert got[i] == (int(cover.sum()), int((np.diff(np.append(0, cover.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert used <= sizes and 16 in used


def test_repeats(spark):
    """A passage at the end of one long text and the beginning of another."""
    passage = " ".join(f"passage{i}" for i in range(60))
    a, b = LONG[: 3 << 20].replace("word", "left"), LONG[: 3 << 20].replace("word", "right")
    a, b = "".join(f"{i}{w}" for i, w in enumerate(a.split("!"))), "".join(f"{w}{i}" for i, w in enumerate(b.split("!")))
    docs = spark.createDataFrame([(1, a + passage), (2, passage + b)], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.removals(docs).collect()}
    kept = {1: a.encode(), 2: b.encode()}
    assert {i: (r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == {i: (len(passage), 1, hashlib.sha256(t).hexdigest()) for i, t in kept.items()}
