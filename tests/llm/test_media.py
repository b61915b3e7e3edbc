import numpy as np
import pytest

from vecspark.llm import media as M
from vecspark.llm import media_fixture as X


def planes(n=3, side=32, seed=0, grey=False):
    rng = np.random.default_rng(seed)
    smooth = lambda s: np.clip(np.kron(rng.integers(40, 200, (n, s // 8, s // 8)), np.ones((1, 8, 8))) + rng.normal(0, 2, (n, s, s)), 0, 255)
    return [smooth(side)] if grey else [smooth(side), smooth(side // 2), smooth(side // 2)]


@pytest.mark.parametrize("grey", [False, True])
@pytest.mark.parametrize("tables", [False, True])
def test_decoded_frames_are_close(grey, tables):
    given = planes(grey=grey)
    for f, raw in enumerate(X.encode_jpegs(given, tables)):
        got = M.decode_jpeg(raw)
        assert len(got) == len(given)
        for a, b in zip(got, given, strict=True):
            assert a.shape == b[f].shape and np.abs(a - b[f]).mean() < 8


def test_block_by_block_against_direct_sums():
    """Frequencies against the textbook double sum."""
    rng = np.random.default_rng(2)
    s = rng.normal(size=(8, 8))
    for u, v in ((0, 0), (3, 5), (7, 1)):
        c = lambda k: np.sqrt(0.5) if k == 0 else 1.0
        want = c(u) * c(v) / 4 * sum(s[y, x] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for y in range(8) for x in range(8))
        assert np.isclose((M.DCT @ s.ravel())[u * 8 + v], want)


def test_films_give_their_plan():
    rng = np.random.default_rng(5)
    for i in range(24):
        v = rng.normal(size=64)
        lengths = X.plan(i, v)
        found, bad, error = M.clips(X.film(i, v))
        assert (bad, error, [c[2] for c in found]) == (0, None, lengths)
        micros = X.MICROS[i % 3]
        assert [(c[3], c[4]) for c in found] == [(sum(lengths[:k]) * micros // 1000, sum(lengths[: k + 1]) * micros // 1000) for k in range(len(lengths))]


def test_frames_with_and_without_index():
    frames = X.encode_jpegs(planes(4))
    for index in (True, False):
        micros, got = M.parse_avi(X.avi(frames, 40_000, index=index))
        assert micros == 40_000 and got == frames
    raw = X.avi(frames, 40_000)
    broken = raw[: raw.index(b"idx1") + 16] + b"\xff" * 4 + raw[raw.index(b"idx1") + 20 :]
    assert M.parse_avi(broken)[1] == frames  # an index that points nowhere is not believed


def test_adaptive_threshold():
    rng = np.random.default_rng(3)
    flicker = np.eye(32)[:1].repeat(60, 0) + 0
    for i in range(60):  # constant large changes are usual, so they cut nothing
        flicker[i, :16] = np.roll(np.eye(16)[0] * 0.6 + np.eye(16)[1] * 0.4, i % 2 * 5)
    assert M.cuts(flicker) == [0]
    calm = np.tile(np.r_[np.eye(16)[2], np.eye(8)[4], np.eye(8)[4]], (30, 1)) + rng.normal(0, 0.002, (30, 32))
    calm[12:, 2], calm[12:, 9] = 0, 1
    assert M.cuts(calm) == [0, 12]
    assert M.cuts(calm[:1]) == [0]


def test_odd_media(spark):
    frames = X.encode_jpegs(planes(4))
    cut = frames[1][: len(frames[1]) // 2]
    good = X.avi(frames, 40_000)
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"not a film"), (5, X.avi([], 40_000)), (6, X.avi([frames[0], cut, b"", frames[0]], 40_000)), (7, X.avi([b"xx"], 40_000)), (8, X.avi(frames, 0)), (None, good), (9, good[:200]), (10, X.avi(frames * 60, 40_000))]
    df = spark.createDataFrame([(i, None if m is None else bytearray(m), "x") for i, m in rows], "media_id long, media binary, clip string")
    got = {}
    for r in M.media_clips(df).collect():
        got.setdefault(r.media_id, []).append(r)
    assert len(got[1]) == 2 * len(got[None]) and got[None][0].error is None
    assert [got[i][0].error for i in (2, 3, 4, 5, 7, 8)] == ["null", "empty", "no AVI", "no frames", "no frame can be decoded", "no frame rate"]
    assert all(r.clip is None for i in (2, 3, 4, 5, 7, 8, 9) for r in got[i]) and got[9][0].error
    assert got[6][0].bad_frames == 1 and got[6][0].n_frames == 4
    assert sum(r.n_frames for r in got[10]) == 240
    assert M.media_clips(df.limit(0)).count() == 0
