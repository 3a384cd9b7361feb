import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import images


def image(h, w, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


@pytest.mark.parametrize("n,size", [(16, 8), (7, 7), (5, 12), (100, 3), (1, 4)])
def test_weights(n, size):
    lo, w = images.taps(n, size)
    assert w.shape[0] == size and np.abs(w.sum(axis=1) - (1 << 22)).max() <= w.shape[1] and (lo >= 0).all() and (lo < n).all()
    if n == size:
        assert all(w[i, i - lo[i]] == 1 << 22 for i in range(n))


def test_resize():
    p = image(9, 13)
    assert (images.resize(p, 13, 9) == p).all() and images.resize(p, 4, 20).shape == (20, 4, 3)
    flat = np.full((8, 8, 3), 77, np.uint8)
    assert (images.resize(flat, 3, 30) == 77).all()
    ramp = np.repeat(np.arange(0, 256, 4, dtype=np.uint8)[None, :, None], 3, axis=2).repeat(4, axis=0)
    half = images.resize(ramp, 32, 4)[0, :, 0].astype(int)
    assert np.abs(half[2:-2] - (np.arange(32) * 8 + 2)[2:-2]).max() <= 1


def test_tones():
    p = image(20, 20, 2) // 2 + 10
    a = images.autocontrast(p)
    assert a.min() == 0 and a.max() == 255 and (images.autocontrast(np.full((2, 2, 3), 5, np.uint8)) == 5).all()
    e = images.equalize(image(64, 64, 3) // 8)
    assert all(len(np.unique(c)) <= 32 for c in np.moveaxis(e, 2, 0)) and e.max() == 255 and abs(float(e.mean()) - 127) < 12
    assert images.solarize(np.array([[[0, 127, 200]]], np.uint8), 128).tolist() == [[[0, 127, 55]]] and images.posterize(np.array([[[255, 17, 128]]], np.uint8), 4).tolist() == [[[240, 16, 128]]]
    assert (images.brightness(p, 1.0) == p).all() and (images.contrast(p, 1.0) == p).all() and (images.color(p, 1.0) == p).all() and (images.sharpness(p, 1.0) == p).all()
    assert (images.brightness(p, 0.0) == 0).all() and len(np.unique(images.contrast(p, 0.0))) == 1 and (np.ptp(images.color(p, 0.0), axis=2) == 0).all()


def test_places():
    p = image(5, 6, 4)
    assert (images.affine(p, (1, 0, 0, 0, 1, 0)) == p).all()
    moved = images.affine(p, (1, 0, 2, 0, 1, 0))
    assert (moved[:, :4] == p[:, 2:]).all() and (moved[:, 4:] == 128).all()
    square = image(7, 7, 5)
    assert (images.rotate(square, 0) == square).all() and (images.rotate(square, 180) == square[::-1, ::-1]).all()


def test_policy_depends_on_the_key_alone(spark):
    p = image(12, 16, 6)
    drawn = [images.choices(str(k)) for k in range(2000)]
    names = [n for d in drawn for n, _ in d]
    assert set(names) == set(images.OPERATIONS) and 0.45 < len(names) / 4000 < 0.55
    for k in range(60):
        assert (images.augment(p, str(k)) == images.augment(p, str(k))).all() and images.augment(p, str(k)).shape == p.shape
    rows = [(k, bytearray(p.tobytes())) for k in range(20)] + [(99, None), (98, bytearray())]
    df = spark.createDataFrame(rows, "k long, p binary").repartition(3)
    got = {r.k: r.q for r in df.select("k", images.transformed(F.col("p"), F.lit(16), images.augment, F.col("k")).alias("q")).collect()}
    assert got[99] is None and bytes(got[98]) == b"" and all(bytes(got[k]) == images.augment(p, str(k)).tobytes() for k in range(20))
