"""PNG members to pixels and back: chunks with checksums, inflating, and the five row filters on whole diagonals at a time."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel, and the depths allowed, for each colour type (fixed values).
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: First column and row, and steps between columns and rows, of the seven passes of an interlaced image (fixed values).
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Pixels of an image at most: a small file can unpack to very many.
MAX_PIXELS = 1 << 26
#: Bytes of images that are unfiltered together, and of those that are held inflated, about (or one image).
TOGETHER, INFLATED = 1 << 20, 8 << 20


class BadImage(ValueError):
    pass


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """The joined bodies of the chunks of each kind, their checksums compared."""
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    out: dict[bytes, list[bytes]] = {}
    at = 8
    while b"IEND" not in out:
        if at + 12 > len(data):
            raise BadImage("the file is cut off")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body, check = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(check) < 4:
            raise BadImage("the file is cut off")
        if zlib.crc32(kind + body) != int.from_bytes(check, "big"):
            raise BadImage(f"the checksum of {kind!r} is wrong")
        out.setdefault(kind, []).append(body)
        at += 12 + n
    return {k: b"".join(v) for k, v in out.items()}


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows (height, columns, bytes of a pixel) as they were before their filters (height): none, left, up, average, Paeth."""
    if not (kinds < 5).all():
        raise BadImage("an unknown row filter")
    return unfilter_many([(kinds, rows)])[0]


def unfilter_many(images: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """unfilter() of many images whose filters are known ones.

    A byte depends on those to its left, above, and above left. So all rows advance together, each one pixel behind the row
    above, and a step works on a whole diagonal, of all images of one width and about one height.
    """
    out = [rows for _, rows in images]
    left = [i for i, (kinds, _) in enumerate(images) if kinds.any()]
    left.sort(key=lambda i: (images[i][1].shape[1:], images[i][1].shape[0]))
    lo = 0
    while lo < len(left):
        h, w, n = images[left[lo]][1].shape
        hi = lo + 1
        while hi < len(left) and images[left[hi]][1].shape[1:] == (w, n) and len(images[left[hi]][1]) <= h + h // 4 + 4 and (hi - lo) * h * w * n < TOGETHER:
            hi += 1
        some = left[lo:hi]
        for i, plain in zip(some, _unfiltered([images[i] for i in some])):
            out[i] = plain
        lo = hi
    return out


def _unfiltered(images: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    h, (w, n), k = max(len(rows) for _, rows in images), images[0][1].shape[1:], len(images)
    kinds, coded = np.zeros((h, 1, 1, k), np.uint8), np.zeros((h, w, n, k), np.uint8)
    for i, (kind, rows) in enumerate(images):
        kinds[: len(rows), 0, 0, i], coded[: len(rows), ..., i] = kind, rows
    out = np.zeros((h + 1, w + 1, n, k), np.int16)  # a row and a column of zeros around it
    for step in range(h + w - 1):
        y = np.arange(max(0, step - w + 1), min(h, step + 1))
        x = step - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        own = kinds[y, 0]
        p_left, p_up, p_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((p_left <= p_up) & (p_left <= p_corner), left, np.where(p_up <= p_corner, up, corner))
        guess = np.where(own == 1, left, np.where(own == 2, up, np.where(own == 3, (left + up) >> 1, np.where(own == 4, paeth, 0))))
        out[y + 1, x + 1] = (coded[y, x] + guess) & 255
    return [out[1 : len(rows) + 1, 1:, :, i].astype(np.uint8) for i, (_, rows) in enumerate(images)]


def _samples(rows: np.ndarray, width: int, samples: int, depth: int) -> np.ndarray:
    """Bytes of rows (height, bytes) as samples (height, width, samples)."""
    if depth == 16:
        return rows.reshape(len(rows), width, samples, 2)[..., 0]  # the high byte
    if depth == 8:
        return rows.reshape(len(rows), width, samples)
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    return (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[..., None]


class _Inflated:
    """A PNG's header, and its passes as they are filtered."""

    def __init__(self, data: bytes):
        parts = _chunks(data)
        if len(parts.get(b"IHDR", b"")) != 13:
            raise BadImage("no header")
        width, height, depth, colour, packing, filters, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
        if not width or not height or depth not in _DEPTHS.get(colour, ()) or packing or filters or interlaced > 1:
            raise BadImage("a header of no kind that there is")
        if width * height > MAX_PIXELS:
            raise BadImage(f"{width} x {height} pixels are too many")
        samples = _SAMPLES[colour]
        size = max(1, samples * depth // 8)
        passes = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in (_PASSES if interlaced else ((0, 0, 1, 1),))]
        passes = [p for p in passes if p[4] > 0 and p[5] > 0]
        strides = [-(-w * samples * depth // 8) for _, _, _, _, w, _ in passes]
        need = sum((s + 1) * p[5] for s, p in zip(strides, passes))
        try:
            inflate = zlib.decompressobj()
            raw = inflate.decompress(parts.get(b"IDAT", b""), need)
        except zlib.error as e:
            raise BadImage(f"the pixels can't be inflated: {e}") from None
        if len(raw) < need:
            raise BadImage("pixels are missing")
        self.palette, self.shape, self.samples, self.depth, self.colour, self.passes = parts.get(b"PLTE", b""), (height, width), samples, depth, colour, passes
        self.filtered, self.bytes, at = [], need, 0
        for (_, _, _, _, _, h), stride in zip(passes, strides):
            lines = np.frombuffer(raw, np.uint8, (stride + 1) * h, at).reshape(h, stride + 1)
            at += (stride + 1) * h
            if not (lines[:, 0] < 5).all():
                raise BadImage("an unknown row filter")
            self.filtered.append((lines[:, 0], lines[:, 1:].reshape(h, stride // size, size)))

    def pixels(self, plain: list[np.ndarray]) -> np.ndarray:
        """The pixels of passes without their filters."""
        samples, depth, colour = self.samples, self.depth, self.colour
        out = np.zeros((*self.shape, samples), np.uint8)
        for (x, y, dx, dy, w, h), rows in zip(self.passes, plain):
            out[y::dy, x::dx] = _samples(rows.reshape(h, -1), w, samples, depth)
        if colour == 3:
            palette = np.frombuffer(self.palette, np.uint8).reshape(-1, 3) if len(self.palette) % 3 == 0 else np.zeros((0, 3), np.uint8)
            if out.max() >= len(palette):
                raise BadImage("a colour outside the palette")
            return palette[out[..., 0]]
        if colour in (0, 4):
            grey = out[..., 0] if depth >= 8 else (out[..., 0].astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
            return np.repeat(grey[..., None], 3, axis=2)
        return out[..., :3]


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width, 3) in 8 bits a colour; BadImage says what is wrong with a file.

    Grey is repeated, palettes are looked up, 16 bits are cut to the high 8, transparency is dropped.
    """
    image = _Inflated(data)
    return image.pixels(unfilter_many(image.filtered))


def decode_many(files: list[bytes | None]) -> list[np.ndarray | BadImage | None]:
    """decode() of many files, with what is wrong in place of the pixels of a broken one; null is null."""
    out: list = [None] * len(files)
    held: list[tuple[int, _Inflated]] = []
    size = 0

    def finish():
        plain = iter(unfilter_many([f for _, image in held for f in image.filtered]))
        for i, image in held:
            try:
                out[i] = image.pixels([next(plain) for _ in image.filtered])
            except BadImage as e:
                out[i] = e
        held.clear()

    for i, x in enumerate(files):
        try:
            if x is not None:
                held.append((i, _Inflated(x)))
        except BadImage as e:
            out[i] = e
            continue
        size += held[-1][1].bytes if x is not None else 0
        if size >= INFLATED:
            finish()
            size = 0
    finish()
    return out


def encode(pixels: np.ndarray, filters: np.ndarray | None = None) -> bytes:
    """A PNG of (height, width, 3) pixels, each row behind the filter of its number (none where there are no numbers)."""
    h, w, _ = pixels.shape
    x = np.zeros((h + 1, w + 1, 3), np.int16)
    x[1:, 1:] = pixels
    own, left, up, corner = x[1:, 1:], x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    p_left, p_up, p_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    paeth = np.where((p_left <= p_up) & (p_left <= p_corner), left, np.where(p_up <= p_corner, up, corner))
    kinds = np.zeros(h, np.uint8) if filters is None else np.asarray(filters, np.uint8)
    guess = np.stack([np.zeros_like(own), left, up, (left + up) >> 1, paeth])[kinds, np.arange(h)]
    lines = np.concatenate([kinds[:, None], ((own - guess) & 255).astype(np.uint8).reshape(h, 3 * w)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


PIXELS = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())])


def decoded(payload: Column) -> Column:
    """(width, height, pixels as bytes of rows of RGB, error) of PNG bytes: a broken one has the error alone, null is null."""

    @F.arrow_udf(PIXELS)
    def read(data: pa.Array) -> pa.Array:
        rows = []
        for p in decode_many(data.to_pylist()):
            if p is None:
                rows.append(None)
            elif isinstance(p, BadImage):
                rows.append({"width": None, "height": None, "pixels": None, "error": str(p)})
            else:
                rows.append({"width": p.shape[1], "height": p.shape[0], "pixels": p.tobytes(), "error": None})
        return pa.array(rows, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]))

    return read(payload)


def encoded(pixels: Column, width: Column, filter_of_first: Column) -> Column:
    """PNG bytes of rows of RGB of a width; rows take the five filters in turn, beginning with a given one."""

    @F.arrow_udf("binary")
    def write(data: pa.Array, w: pa.Array, first: pa.Array) -> pa.Array:
        out = []
        for x, n, f in zip(data.to_pylist(), w.to_pylist(), first.to_pylist()):
            p = None if x is None else np.frombuffer(x, np.uint8).reshape(-1, n, 3)
            out.append(None if p is None or not len(p) else encode(p, (np.arange(len(p)) + f) % 5))
        return pa.array(out, pa.binary())

    return write(pixels, width, filter_of_first)
