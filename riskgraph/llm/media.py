"""Images in binary columns: Netpbm and BMP codecs, area resize, NPY tiles and difference hashes.

``decode`` reads P2/P3/P5/P6 Netpbm with 8-bit samples and uncompressed 8- or
24-bit BMP into ``uint8`` arrays of shape (height, width, channels);
``encode_pnm`` and ``encode_bmp`` write P5/P6 and 24-bit BMP. ``area_resize`` averages the exact
area under each output pixel by differences of an integral image.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 192  # bytes of a row of 64 RGB pixels


def encode_pnm(image: np.ndarray) -> bytes:
    """P5 for one channel, P6 for three."""
    h, w, c = image.shape
    return b"P%d\n%d %d\n255\n" % (6 if c == 3 else 5, w, h) + image.tobytes()


def _pnm(data: bytes) -> np.ndarray:
    at, fields = 2, []
    while len(fields) < 3:  # white space and comments part the header's numbers
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a number is missing in the Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields
    if not 0 < top < 256:
        raise ValueError("only 8-bit samples are read")
    c = 3 if data[1:2] in b"36" else 1
    if data[1:2] in b"56":
        flat = np.frombuffer(data, np.uint8, w * h * c, at + 1)
    else:
        flat = np.array(data[at:].split()[: w * h * c], np.uint8)
    return flat.reshape(h, w, c)


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP, rows from the bottom up; one channel is written as grey."""
    h, w, c = image.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = np.broadcast_to(image, (h, w, 3))[::-1, :, ::-1].reshape(h, 3 * w)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _bmp(data: bytes) -> np.ndarray:
    (offset,) = struct.unpack_from("<I", data, 10)
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed 8- and 24-bit BMP is read")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits == 24:
        return rows[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
    (used,) = struct.unpack_from("<I", data, 46)
    palette = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + size).reshape(-1, 4)[:, 2::-1]
    return palette[rows[:, :w]]


def decode(data: bytes) -> np.ndarray:
    """The image as uint8 (height, width, channels); ValueError for another format."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in (b"2", b"3", b"5", b"6"):
        return _pnm(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each output pixel's area, as float64 (height, width, channels).

    The integral image is read between samples by linear interpolation, which is
    exact as the image is constant within each pixel.
    """
    h, w, c = image.shape
    total = np.zeros((h + 1, w + 1, c))
    total[1:, 1:] = image.cumsum(0, dtype=np.float64).cumsum(1)

    def between(table: np.ndarray, n: int, parts: int) -> np.ndarray:
        at = np.arange(parts + 1) * n / parts
        low = np.minimum(at.astype(int), n - 1)
        share = (at - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - share) + table[low + 1] * share

    rows = between(total, h, height)
    cells = between(rows.swapaxes(0, 1), w, width).swapaxes(0, 1)
    return np.diff(np.diff(cells, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether the mean grey rises from each of 8 x 9 areas to the next on its right."""
    grey = np.floor(area_resize(image, 8, 9).mean(2) * 256 + 0.5)
    return np.packbits(grey[:, 1:] > grey[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = 16) -> bytes:
    """The image area-resized to ``size`` x ``size`` uint8, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.floor(area_resize(image, size, size) + 0.5).clip(0, 255).astype(np.uint8))
    return out.getvalue()


def text_image(text: str | None) -> tuple[bytes, bytes]:
    """The text's UTF-8 bytes and their P6 image of 64 pixels a row, filled up with spaces."""
    raw = (text or "").encode("utf-8", "replace")
    padded = raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" ")
    return raw, encode_pnm(np.frombuffer(padded, np.uint8).reshape(-1, ROW // 3, 3))


def _rows(batches):
    for batch in batches:
        out = []
        for text in batch.column(0):  # one text at a time, so that long ones don't add up
            raw, media = text_image(text.as_py())
            image = decode(media)
            payload = image.tobytes()
            tile, bitmap = npy_tile(image), encode_bmp(image)
            if not np.array_equal(decode(bitmap), image):
                raise ValueError("a BMP doesn't give its image back")
            out.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), len(bitmap), hashlib.sha256(bitmap).hexdigest(), tile))
        columns = list(zip(*out)) or [()] * 10
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        made = [pa.array(c, k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*batch.schema.names[1:], *FIELDS])


FIELDS = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string", "bmp_bytes": "bigint", "bmp_sha256": "string", "tile": "binary"}


def media_columns(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``df`` with the columns ``keep`` and FIELDS.

    Each text is stored as a P6 image, read back and described: digests of
    payload and stored form, a difference hash (``feature``), the digest of the same image's BMP form and an NPY tile.
    A null text counts as empty (one row of spaces). Rows repeat as they do in
    ``df``; other columns of ``df`` are ignored, whatever their names. The work is per row: no shuffle,
    and a task holds one image and a batch's small results.
    """
    kept = df.select(F.col(text).alias("__text"), *keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]] + [f"{k} {v}" for k, v in FIELDS.items()])
    return kept.mapInArrow(_rows, schema)
