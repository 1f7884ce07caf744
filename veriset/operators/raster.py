"""Kernels over label images: decoding, encoding checks, boundary matches, shape features.

One image is a row; each is worked on where it lies, an Arrow batch at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.operators.shipping import prepare

IGNORE, MOST_LABEL = 255, 115
RASTER = "height int, width int, pixels binary"


def decode_png(data: bytes) -> np.ndarray:
    """Values of a greyscale or palette PNG of 1 to 16 bits as a 2-d array; other kinds raise."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + chunk) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("broken PNG chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None:
        raise ValueError("PNG without a header")
    width, height, bits, colour, _, _, interlaced = head
    if colour not in (0, 3) or interlaced:
        raise ValueError("only plain greyscale or palette images hold one label a pixel")
    per_row, step = (width * bits + 7) // 8, max(1, bits // 8)
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, per_row + 1)
    rows = np.zeros((height + 1, per_row), np.uint8)
    for y in range(height):
        rows[y + 1] = _unfilter(int(raw[y, 0]), raw[y, 1:], rows[y], step)
    out = rows[1:]
    if bits == 16:
        return out.reshape(height, width, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if bits == 8:
        return out
    parts = np.unpackbits(out, axis=1).reshape(height, -1, bits)
    return (parts @ (1 << np.arange(bits - 1, -1, -1)))[:, :width].astype(np.uint8)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One line of a PNG from its differences."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    out = line.astype(np.int64)
    if kind == 1:
        for k in range(step):
            out[k::step] = np.cumsum(out[k::step])
        return (out & 255).astype(np.uint8)
    if kind not in (3, 4):
        raise ValueError("unknown PNG filter")
    up = above.astype(np.int64)
    for i in range(len(out)):
        left = int(out[i - step]) if i >= step else 0
        if kind == 3:
            guess = (left + int(up[i])) // 2
        else:
            corner = int(up[i - step]) if i >= step else 0
            flat = left + int(up[i]) - corner
            guess = min((left, int(up[i]), corner), key=lambda x: abs(flat - x))
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)


def decode_masks(files: DataFrame) -> DataFrame:
    """``path, content`` of PNG files -> ``path, height, width, pixels`` (a byte a pixel, row by row)."""
    prepare(files.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = decode_png(content)
                if x.max(initial=0) > 255:
                    raise ValueError(f"{path}: labels beyond a byte")
                yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([n], pa.int32()) for n in x.shape), pa.array([x.astype(np.uint8).tobytes()], pa.binary())], names=["path", "height", "width", "pixels"])

    return files.select("path", "content").mapInArrow(decode, f"path string, {RASTER}")


def _image(pixels: bytes, height: int, width: int) -> np.ndarray:
    x = np.frombuffer(pixels, np.uint8)
    if len(x) != height * width:
        raise ValueError(f"{len(x)} pixels instead of {height} x {width}")
    return x.reshape(height, width)


def value_range(rasters: DataFrame, key: str = "path") -> DataFrame:
    """``key, low, high, values``: least and greatest label and all distinct ones, ascending."""
    prepare(rasters.sparkSession)
    kind = dict(rasters.dtypes)[key]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.bincount(np.frombuffer(p, np.uint8), minlength=1)).tolist() for p in batch.column(1).to_pylist()]
            ends = [[v[k] if v else None for v in found] for k in (0, -1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(e, pa.int32()) for e in ends), pa.array(found, pa.list_(pa.int32()))], names=["key", "low", "high", "values"])

    return rasters.select(key, "pixels").mapInArrow(look, f"key {kind}, low int, high int, values array<int>").withColumnRenamed("key", key)


def invalid_masks(rasters: DataFrame, key: str = "path", most: int = MOST_LABEL) -> DataFrame:
    """Images that hold no pixel or a label beyond ``most`` (255, to be ignored, must not occur)."""
    return value_range(rasters, key).where(F.col("high").isNull() | (F.col("high") > most))


def _square(x: np.ndarray, reach: int) -> np.ndarray:
    """Where a true pixel lies within ``reach`` in either direction."""
    out = x.copy()
    for axis in (0, 1):
        wide = out.copy()
        for d in range(1, reach + 1):
            for a, b in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
                here, there = ((a, slice(None)), (b, slice(None))) if axis == 0 else ((slice(None), a), (slice(None), b))
                wide[here] |= out[there]
        out = wide
    return out


def _cross(x: np.ndarray) -> np.ndarray:
    """Where a true pixel lies here or beside, above or below."""
    out = x.copy()
    out[1:] |= x[:-1]
    out[:-1] |= x[1:]
    out[:, 1:] |= x[:, :-1]
    out[:, :-1] |= x[:, 1:]
    return out


def boundary_counts(pred: np.ndarray, label: np.ndarray, tolerance: int = 2) -> tuple[float, float, float]:
    """Boundary pixels of foregrounds that match within ``tolerance``: hits (the mean of both directions), surplus, missed.

    A boundary is what growing and shrinking the foreground by one pixel changes; beyond
    the border there is no foreground.
    """
    if pred.shape != label.shape:
        raise ValueError("images of different shape")
    edges = []
    for x in (pred > 0, label > 0):
        framed = np.pad(~x, 1, constant_values=True)
        edges.append(_cross(x) & _cross(framed)[1:-1, 1:-1])
    p, y = edges
    hit_p, hit_y = int((p & _square(y, tolerance)).sum()), int((y & _square(p, tolerance)).sum())
    return (hit_p + hit_y) / 2, float(max(0, int(p.sum()) - hit_p)), float(max(0, int(y.sum()) - hit_y))


def boundary_parts(pairs: DataFrame, key: str = "item", tolerance: int = 2) -> DataFrame:
    """``key, height, width, pred, label`` (pixels) -> ``key, tp, fp, fn``."""
    prepare(pairs.sparkSession)
    kind = dict(pairs.dtypes)[key]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [boundary_counts(_image(p, h, w), _image(y, h, w), tolerance) for h, w, p, y in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([t[k] for t in told], pa.float64()) for k in range(3))], names=["key", "tp", "fp", "fn"])

    return pairs.select(key, "height", "width", "pred", "label").mapInArrow(match, f"key {kind}, tp double, fp double, fn double").withColumnRenamed("key", key)


def hull_area(y: np.ndarray, x: np.ndarray) -> float:
    """Area of the convex hull of pixel centres; 0 where they lie on a line."""
    ends = {}  # only the first and last pixel of a line can be corners
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    new = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    last = np.r_[new[1:], len(y)] - 1
    points = sorted({(int(x[i]), int(y[i])) for i in np.r_[new, last].tolist()})
    del ends
    if len(points) < 3:
        return 0.0
    chain: list[tuple[int, int]] = []
    for run in (points, points[::-1]):
        start = len(chain)
        for p in run:
            while len(chain) - start >= 2 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        chain.pop()
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(chain, [*chain[1:], chain[0]], strict=True))) / 2


FEATURES = "size_ratio double, chr_value double, edge_contact boolean, classes array<int>, class_pixels map<int,bigint>"


def shape_features(image: np.ndarray, most: int = MOST_LABEL) -> tuple[float, float, bool, list[int], list[tuple[int, int]]]:
    """Share of foreground, its area by that of its convex hull, whether it touches the border, and pixels of each class.

    The hull goes through pixel centres; fewer than three pixels, or pixels without a hull's area, count as in ``FEATURES``' contract: share of hull is 1 for one or two pixels and 0 where the hull has none.
    """
    fore = image > 0
    area = int(fore.sum())
    y, x = np.nonzero(fore)
    hull = hull_area(y, x) if area >= 3 else float(area)
    touches = bool(fore[0].any() or fore[-1].any() or fore[:, 0].any() or fore[:, -1].any()) if image.size else False
    counts = np.bincount(image.reshape(-1), minlength=most + 1)[1 : most + 1]
    classes = (np.flatnonzero(counts) + 1).tolist()
    return area / max(1, image.size), area / hull if hull > 0 else 0.0, touches, classes, [(c, int(counts[c - 1])) for c in classes]


def raster_features(rasters: DataFrame, key: str = "path") -> DataFrame:
    """``key, height, width, pixels`` -> ``key`` and the columns of ``FEATURES``."""
    prepare(rasters.sparkSession)
    kind = dict(rasters.dtypes)[key]
    types = [pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int32()), pa.map_(pa.int32(), pa.int64())]
    names = ["size_ratio", "chr_value", "edge_contact", "classes", "class_pixels"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [shape_features(_image(p, h, w)) for h, w, p in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([t[k] for t in told], types[k]) for k in range(5))], names=["key", *names])

    return rasters.select(key, "height", "width", "pixels").mapInArrow(measure, f"key {kind}, {FEATURES}").withColumnRenamed("key", key)
