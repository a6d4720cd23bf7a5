"""Model files of the n-gram model: each mapped once, and few, however many buckets there are."""
import pytest

from lettermill.llm import kneser


def test_spans():
    assert [kneser.span_of(n) for n in (1, 40, 128, 129, 4000, 4096, 10**7)] == [1, 1, 1, 2, 32, 32, 32]


@pytest.mark.parametrize("blocks", [1, 5])
def test_maps_do_not_follow_the_buckets(spark, monkeypatch, blocks):
    """A worker that scores the same text with 40, 400 and 4,000 buckets maps FILES files of a kind at most, whatever the number of blocks."""
    texts = [" ".join(f"w{(i * 7919 + j * j) % 5003}" for j in range(400)).encode() for i in range(60)]
    table = spark.createDataFrame([(t,) for t in texts], "t binary")
    size = sum(map(len, texts)) + len(texts)
    maps, scores, mapped = {}, {}, kneser._map
    for buckets in (1, 40, 400, 4000):
        model = kneser.train(table, max(1, -(-size // buckets)), fan=64)
        seen = []
        monkeypatch.setattr(kneser, "_map", lambda *a: (seen.append(a[1:]), mapped(*a))[1])  # noqa: B023
        scorer, n, got = kneser.Scorer(model), len(texts) // blocks, []
        for k in range(0, len(texts), n):
            left, right, _ = kneser.sequences(texts[k : k + n])
            got += scorer.log10(left, right)[0].tolist()
        monkeypatch.setattr(kneser, "_map", mapped)
        assert len(seen) == len(set(seen)) and model.buckets == pytest.approx(buckets, rel=0.05)
        maps[buckets], scores[buckets] = len(seen), got
    assert scores[40] == pytest.approx(scores[1]) and scores[4000] == pytest.approx(scores[1]) and scores[400] == pytest.approx(scores[1])
    assert maps[40] <= 80 and maps[400] <= 2 * kneser.FILES and maps[4000] <= 2 * kneser.FILES


def test_a_failed_task_leaves_no_file(tmp_path):
    """A file is in place whole or not at all."""
    import os

    import pyarrow as pa

    def make(bucket, blobs):
        if bucket == 3:
            raise OSError("lost")
        return kneser._nothing("right"), []

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int32()), pa.array([b"", b"", b""])], ["bucket", "blob"])
    with pytest.raises(OSError, match="lost"):
        list(kneser._filed(str(tmp_path), "right", 1, make)(iter([batch])))
    assert sorted(os.listdir(tmp_path)) == ["right-1"]
    list(kneser._filed(str(tmp_path), "right", 2, lambda b, blobs: (kneser._nothing("right"), []))(iter([batch])))
    assert sorted(os.listdir(tmp_path)) == ["right-0", "right-1"] and set(kneser._map(str(tmp_path), "right", 1)) == {2, 3}
