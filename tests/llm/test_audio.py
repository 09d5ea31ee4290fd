import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import audio


def recordings():
    rnd = np.random.default_rng(4)
    full = [audio.tones(rnd.normal(size=64).tolist()) for _ in range(12)]
    part = full[0][7 * audio.HOP : 7 * audio.HOP + 60 * audio.HOP]
    noisy = full[1] + rnd.normal(scale=0.02, size=len(full[1]))
    out = [*full, part, noisy, full[2], np.zeros(audio.RATE * 8), np.zeros(100)]
    pcm = [(np.clip(x, -1, 1) * 30000).astype("<i2").tobytes() for x in out]
    return [*enumerate(pcm), (17, None), (18, b""), (19, b"\1"), (2, pcm[2]), (None, pcm[3])]


def brute(rows):
    fps = {}
    for i, x in rows:
        fp = audio.integers(audio.chroma(audio.pcm16(x or b"")))
        if len(fp) and i is not None:
            fps.setdefault(fp.tobytes(), (i, fp))
    out = {}
    for a, x in fps.values():
        for b, y in fps.values():
            for o in range(-len(x), len(y)) if a != b else ():
                bits, n = audio.unlike(x.view(np.int32), y.view(np.int32), o)
                if n >= audio.OVERLAP and bits <= audio.UNLIKE * 32 * n:
                    out[a, b] = min(out.get((a, b), (9, 0, 0)), (bits / n, -n, o))
    return {k: v[2] for k, v in out.items()}


def test_search_finds_parts_and_noisy_copies(spark):
    rows = recordings()
    media = spark.createDataFrame(rows, "k long, audio binary").withColumn("fp", F.lit(1)).repartition(3)
    got = audio.search(media, "k", "audio", audio.pcm16, F.col("id") >= 0).collect()
    member = sorted(((r.id, r.class_id) for r in got if r.match_id is None), key=str)
    assert len(member) == len(rows)
    of = dict(member)
    assert of[14] == 2 and of[None] == 3 and all(of[i] == i for i in (0, 1, 12, 13, 16, 17, 18, 19))
    pairs = {(r.id, r.match_id): r.offset for r in got if r.match_id is not None}
    want = brute(rows)
    assert pairs == {k: want[k] for k in pairs}
    assert pairs[12, 0] == 7 and pairs[0, 12] == -7 and pairs[1, 13] == 0
    assert len(pairs) >= 0.9 * len(want)


def damaged():
    """Recordings and copies of them cut between hops, in noise, and both."""
    rnd = np.random.default_rng(9)
    full = [audio.tones(rnd.normal(size=64).tolist()) for _ in range(40)]
    out = list(full)
    for k, x in enumerate(full):
        noise = lambda s, n=len(x): rnd.normal(scale=s, size=n)
        out.append([lambda: x[344:], lambda: x[230 + 9 * audio.HOP : 230 + 57 * audio.HOP], lambda: x + noise(0.3), lambda: x + noise(1.0), lambda: (x + noise(0.8))[500:]][k % 5]())
    return [(k, (np.clip(x / 4, -1, 1) * 30000).astype("<i2").tobytes()) for k, x in enumerate(out)]


@pytest.mark.parametrize("block", [1 << 21, 5000])
def test_recall_on_damaged_copies(spark, monkeypatch, block):
    monkeypatch.setattr(audio, "PROBES", block)
    rows = damaged()
    media = spark.createDataFrame(rows, "k long, audio binary").repartition(8)
    got = {(r.id, r.match_id): r.offset for r in audio.search(media, "k", "audio", audio.pcm16, F.col("id") >= 0).collect() if r.match_id is not None}
    want = brute(rows)
    assert got == {k: want[k] for k in got} and len(want) >= 2 * 35
    assert len(got) >= 0.95 * len(want)


def test_a_decoder_that_raises_leaves_no_integers(spark):
    media = spark.createDataFrame([(1, b"x"), (2, b"y")], "k long, audio binary")

    def broken(x):
        raise ValueError(x)

    got = audio.search(media, "k", "audio", broken, F.lit(True)).collect()
    assert sorted((r.id, r.class_id, r.places) for r in got) == [(1, 1, 0), (2, 2, 0)]


def test_empty_table(spark):
    assert audio.search(spark.createDataFrame([], "k long, audio binary"), "k", "audio", audio.pcm16, F.lit(True)).count() == 0
