"""Media columns: Netpbm and BMP files decoded to numpy arrays, area-resized by integral images, written as NPY tiles
with difference hashes.

``decode`` reads Netpbm P1 to P6 (bit, grey and pixel maps, plain and raw, 8 and 16 bits) and BMP with 8, 24 or 32 bits,
bottom-up or top-down. ``area_resize`` averages the exact area of each target cell, fractions of pixels included, from
one integral image. ``difference_hash`` compares neighbours of a 9 x 8 grey reduction. ``tiles`` writes NPY bytes.

Edge cases: a null or empty text is one padded row of pixels; bytes that are no known format, or cut short, raise
ValueError in ``decode`` and give nulls in ``describe``; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

ROW_BYTES = 576
WIDTH = ROW_BYTES // 3
TILE = 32


def decode(data: bytes) -> np.ndarray:
    """height x width (grey) or height x width x channels, as stored: 8 or 16 bits without loss."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("BMP header is cut short")
    offset, size, width, height, _, bits, method = struct.unpack_from("<I I i i H H I", data, 10)
    if size < 40 or method not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("unsupported BMP")
    # fixed values: masks of red, green and blue in a 32-bit pixel of blue, green, red and a fourth byte
    if method == 3 and (bits != 32 or len(data) < 66 or struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("unsupported BMP: other masks")
    stride, rows = (width * bits // 8 + 3) & ~3, abs(height)
    if len(data) < offset + stride * rows:
        raise ValueError("BMP pixels are cut short")
    px = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)[:, : width * bits // 8]
    px = px if height < 0 else px[::-1]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        entries = np.frombuffer(data, np.uint8, 4 * min(colours, 256), 14 + size).reshape(-1, 4)
        palette[: len(entries)] = entries
        return palette[px][..., [2, 1, 0]]
    return px.reshape(rows, width, bits // 8)[..., [2, 1, 0] if bits == 24 else [2, 1, 0, 3]]


_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = int(data[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("Netpbm header is cut short")
        fields.append(int(m[1]))
        at = m.end()
    width, height = fields[:2]
    most, channels = (fields[2] if kind not in (1, 4) else 1), 3 if kind in (3, 6) else 1
    if not width or not height or not 0 < most < 65536:
        raise ValueError("bad Netpbm size")
    shape = (height, width, 3) if channels == 3 else (height, width)
    n = height * width * channels
    if kind <= 3:
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        values = [int(b) for b in re.findall(rb"[01]", body)] if kind == 1 else [int(b) for b in body.split()]
        if len(values) < n:
            raise ValueError("Netpbm pixels are cut short")
        px = np.array(values[:n], np.uint16 if most > 255 else np.uint8).reshape(shape)
        return 255 * (1 - px) if kind == 1 else px
    at += 1
    if kind == 4:
        stride = (width + 7) // 8
        if len(data) < at + stride * height:
            raise ValueError("Netpbm pixels are cut short")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride), axis=1)[:, :width]
        return (255 * (1 - bits)).astype(np.uint8)
    wide = 2 if most > 255 else 1
    if len(data) < at + n * wide:
        raise ValueError("Netpbm pixels are cut short")
    return np.frombuffer(data, ">u2" if wide == 2 else np.uint8, n, at).astype(np.uint16 if wide == 2 else np.uint8).reshape(shape)


def encode_bmp(rgb: np.ndarray) -> bytes:
    """A 24-bit bottom-up BMP."""
    height, width = rgb.shape[:2]
    stride = (3 * width + 3) & ~3
    px = np.zeros((height, stride), np.uint8)
    px[:, : 3 * width] = rgb[::-1, :, ::-1].reshape(height, 3 * width)
    head = struct.pack("<2sIHHI IiiHHIIiiII", b"BM", 54 + px.size, 0, 0, 54, 40, width, height, 1, 24, 0, px.size, 2835, 2835, 0, 0)
    return head + px.tobytes()


def encode_ppm(rgb: np.ndarray) -> bytes:
    """A raw pixel map, P6."""
    return b"P6\n%d %d\n255\n" % (rgb.shape[1], rgb.shape[0]) + np.ascontiguousarray(rgb).tobytes()


def integral(image: np.ndarray) -> np.ndarray:
    """Sums of all samples above and left of each pixel corner, by channel. 8-bit samples sum exactly in 64 bits."""
    px = image[..., None] if image.ndim == 2 else image
    table = np.zeros((px.shape[0] + 1, px.shape[1] + 1, px.shape[2]), np.int64)
    np.cumsum(np.cumsum(px, axis=0, dtype=np.int64), axis=1, out=table[1:, 1:])
    return table


def area_means(table: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means by channel. The table is read at fractional corners by linear interpolation, which is exact as
    pixels are constant over their area."""
    rows, columns = table.shape[0] - 1, table.shape[1] - 1

    def at(n: int, cells: int):
        edge = np.arange(cells + 1) * (n / cells)
        low = np.minimum(edge.astype(np.int64), n - 1)
        return low, edge - low

    y, fy = at(rows, height)
    x, fx = at(columns, width)
    bands = table[y] * (1 - fy)[:, None, None] + table[y + 1] * fy[:, None, None]
    corners = bands[:, x] * (1 - fx)[None, :, None] + bands[:, x + 1] * fx[None, :, None]
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / (rows / height * columns / width)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    out = area_means(integral(image), height, width)
    return out[..., 0] if image.ndim == 2 else out


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image[..., :3] @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each cell of 8 x 8 is darker than its right neighbour."""
    return hash_of(integral(image))


def hash_of(table: np.ndarray) -> str:
    small = area_means(table, 8, 9)
    small = np.round(grey(small) if small.shape[2] >= 3 else small[..., 0], 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image reduced to a square of 8-bit samples, as an NPY file."""
    return tile_of(integral(image), side)


def tile_of(table: np.ndarray, side: int = TILE) -> bytes:
    small = np.clip(np.rint(area_means(table, side, side)), 0, 255).astype(np.uint8)
    return npy(small if small.shape[2] > 1 else small[..., 0])


def payload_image(text: str) -> tuple[bytes, bytes]:
    """UTF-8 bytes, padded by 255 to a positive multiple of a row, and the BMP that stores them."""
    data = text.encode("utf-8", "surrogatepass")
    padded = data + b"\xff" * ((-len(data)) % ROW_BYTES or (0 if data else ROW_BYTES))
    return data, encode_bmp(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH, 3))


DESCRIBED = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile_sha256", pa.string()),
])


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text stored as a BMP of 192 pixels a row."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                made = [payload_image(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(d) for d, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Digest columns of stored media: decoded samples, hashes, feature; nulls where media can't be decoded."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    image = decode(data or b"")
                except ValueError:
                    rows.append((doc_id, n, *[None] * 7))
                    continue
                payload, table = np.ascontiguousarray(image).tobytes(), integral(image)
                small = tile_of(table)
                rows.append((
                    doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(),
                    hash_of(table), hashlib.sha256(small).hexdigest(),
                ))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in DESCRIBED]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, DESCRIBED, strict=True)], schema=DESCRIBED)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    return media.mapInArrow(run, schema)


def tiles(media: DataFrame, side: int = TILE) -> DataFrame:
    """doc_id, dhash and the NPY tile itself; media that can't be decoded gives nulls."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    image = decode(data or b"")
                    table = integral(image)
                    rows.append((doc_id, hash_of(table), tile_of(table, side)))
                except ValueError:
                    rows.append((doc_id, None, None))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "dhash", "tile"])

    return media.mapInArrow(run, "doc_id long, dhash string, tile binary")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return describe(text_media(table(spark, sf_dir, "documents")))
