import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import png


def plain_unfilter(kinds, rows):
    """Byte by byte, as the format says."""
    h, w, n = rows.shape
    out = np.zeros((h, w, n), int)
    for y in range(h):
        for x in range(w):
            for c in range(n):
                a = out[y, x - 1, c] if x else 0
                b = out[y - 1, x, c] if y else 0
                d = out[y - 1, x - 1, c] if x and y else 0
                p = a + b - d
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                out[y, x, c] = (int(rows[y, x, c]) + [0, a, b, (a + b) // 2, near][kinds[y]]) % 256
    return out


def test_filters_against_a_loop():
    r = np.random.default_rng(1)
    for h, w, n in [(1, 1, 1), (7, 5, 3), (5, 9, 4), (12, 1, 2), (1, 12, 6)]:
        kinds, rows = r.integers(0, 5, h), r.integers(0, 256, (h, w, n)).astype(np.uint8)
        assert (png.unfilter(kinds, rows) == plain_unfilter(kinds, rows)).all()
        pixels = r.integers(0, 256, (h, w, 3)).astype(np.uint8)
        assert (png.decode(png.encode(pixels, kinds)) == pixels).all()


def file(width, height, depth, colour, lines, interlaced=0, palette=b""):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_kinds_of_images():
    assert png.decode(file(3, 1, 8, 0, b"\0\x01\x80\xff")).tolist() == [[[1] * 3, [128] * 3, [255] * 3]]
    assert png.decode(file(9, 1, 1, 0, b"\0\xaa\x80"))[0, :, 0].tolist() == [255, 0] * 4 + [255]
    assert png.decode(file(3, 1, 2, 0, b"\0\x1b"))[0, :, 0].tolist() == [0, 85, 170]
    assert png.decode(file(2, 1, 4, 3, b"\0\x10", palette=b"abcdef")).tolist() == [[[100, 101, 102], [97, 98, 99]]]
    assert png.decode(file(1, 1, 16, 2, b"\0" + bytes([1, 99, 2, 99, 3, 99]))).tolist() == [[[1, 2, 3]]]
    assert png.decode(file(2, 1, 8, 4, b"\0\x05\x00\x06\xff"))[0, :, 0].tolist() == [5, 6] and png.decode(file(1, 1, 8, 6, b"\0\1\2\3\4")).tolist() == [[[1, 2, 3]]]


def test_interlaced():
    want = np.random.default_rng(2).integers(0, 256, (11, 9)).astype(np.uint8)
    lines = b"".join(b"\0" + row.tobytes() for x, y, dx, dy in png._PASSES for row in want[y::dy, x::dx] if row.size)
    assert (png.decode(file(9, 11, 8, 0, lines, 1))[..., 0] == want).all()


def test_broken_ones_say_why(spark):
    good = png.encode(np.arange(48, dtype=np.uint8).reshape(4, 4, 3), np.array([0, 1, 2, 3]))
    flipped = bytearray(good)
    flipped[45] ^= 1
    cases = {b"GIF89a": "signature", good[:40]: "cut off", good[:-1]: "cut off", bytes(flipped): "checksum", file(4, 4, 8, 2, b"\0" * 10): "missing", file(1, 1, 8, 3, b"\0\1", palette=b"abc"): "palette"}
    cases |= {file(1, 1, 3, 2, b"\0"): "header", file(1, 1, 8, 0, b"\7a"): "filter", file(1 << 20, 1 << 20, 8, 0, b"\0"): "too many"}
    df = spark.createDataFrame([(bytearray(x), why) for x, why in [*cases.items(), (good, ""), (b"", "signature")]] + [(None, None)], "payload binary, why string")
    rows = df.select("why", png.decoded(F.col("payload")).alias("p")).collect()
    for r in rows:
        assert (r.p is None) if r.why is None else (r.p.pixels is not None and r.p.error is None and (r.p.width, r.p.height) == (4, 4)) if r.why == "" else (r.p.pixels is None and r.why in r.p.error), r
    r = random.Random(3)
    for _ in range(300):
        x = bytearray(good)
        for _ in range(r.randrange(1, 4)):
            x[r.randrange(len(x))] = r.randrange(256)
        try:
            png.decode(bytes(x[: r.randrange(len(x) + 1)]))
        except png.BadImage:
            pass


@pytest.mark.parametrize("size", [(480, 640)])
def test_large_images_in_steps(size):
    p = np.random.default_rng(4).integers(0, 256, (*size, 3)).astype(np.uint8)
    assert (png.decode(png.encode(p, np.arange(size[0]) % 5)) == p).all()


def test_many_files_are_decoded_together(monkeypatch):
    r = np.random.default_rng(5)
    images = [r.integers(0, 256, (int(h), int(w), 3), np.uint8) for h, w in zip(r.integers(1, 40, 120), r.choice([3, 16], 120))]
    files = [png.encode(p, r.integers(0, 5, len(p))) for p in images]
    calls = []
    work = png._unfiltered
    monkeypatch.setattr(png, "_unfiltered", lambda some: calls.append(len(some)) or work(some))
    got = png.decode_many([*files, None, files[0][:-9], b"x"])
    assert all(np.array_equal(a, b) for a, b in zip(got, images)) and len(calls) < 30
    assert got[120] is None and isinstance(got[121], png.BadImage) and isinstance(got[122], png.BadImage)
    monkeypatch.setattr(png, "INFLATED", 500)
    monkeypatch.setattr(png, "TOGETHER", 500)
    assert all(np.array_equal(a, b) for a, b in zip(png.decode_many(files), images))
