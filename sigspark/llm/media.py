"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, hashed and tiled.

Images stay encoded in a binary column; each task decodes the images of its own rows, one at a time.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from sigspark.llm import storage

PAYLOAD_WIDTH = 64
UNIT = 3 * PAYLOAD_WIDTH
TILE = 16
_FIELD = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*(\d+)")
COPY_BYTES = 1 << 20  # images up to this size are summed through a copy in doubles


class MediaError(ValueError):
    """Bytes that are no whole image of a supported kind."""


def encode_ppm(pixels: np.ndarray) -> bytes:
    """A binary Netpbm image (P6) of a height x width x 3 array of bytes."""
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP, bottom row first, of a height x width x 3 array of bytes."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """A P1 to P6 image as a height x width (x 3) array of bytes; wider samples are scaled to 0..255."""
    kind, at = data[:2], 2
    if not re.fullmatch(rb"P[1-6]", kind):
        raise MediaError("not a Netpbm image")
    fields = []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _FIELD.match(data, at)):
            raise MediaError("Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, most = (*fields, 1)[:3]
    if not (w and h and 0 < most < 65536):
        raise MediaError("Netpbm size")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * depth
    if kind in (b"P1", b"P2", b"P3"):
        words = re.sub(rb"#[^\r\n]*", b"", data[at:])
        values = re.findall(rb"[01]" if kind == b"P1" else rb"\d+", words)[:n]
        raw = np.array(values).astype(np.int64) if values else np.empty(0, np.int64)
    elif kind == b"P4":
        stride = -(-w // 8)
        packed = np.frombuffer(data, np.uint8, min(stride * h, len(data) - at - 1), at + 1)
        if packed.size < stride * h:
            raise MediaError("Netpbm data end early")
        raw = np.unpackbits(packed.reshape(h, stride), axis=1)[:, :w].ravel()
    else:
        kind_of = np.dtype(np.uint8 if most < 256 else ">u2")
        raw = np.frombuffer(data, kind_of, min(n, (len(data) - at - 1) // kind_of.itemsize), at + 1)
    if raw.size < n:
        raise MediaError("Netpbm data end early")
    if kind in (b"P1", b"P4"):
        raw = 255 * (1 - raw.astype(np.int64))
    elif most != 255:
        raw = (raw.astype(np.int64) * 255 + most // 2) // most
    return raw.astype(np.uint8, copy=False).reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 8, 24 or 32 bits as a height x width x 3 array of bytes."""
    if len(data) < 54 or data[:2] != b"BM":
        raise MediaError("not a BMP image")
    start, head, w, h, _, bits, packing = struct.unpack_from("<10xIIiiHHI", data)
    if packing or bits not in (8, 24, 32) or w <= 0 or h == 0:
        raise MediaError("BMP kind")
    stride = -(-w * bits // 32) * 4
    if len(data) < start + stride * abs(h):
        raise MediaError("BMP data end early")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        n = struct.unpack_from("<46xI", data)[0] or 256
        if n > 256 or len(data) < 14 + head + 4 * n:
            raise MediaError("BMP colours")
        colours = np.zeros((256, 3), np.uint8)
        colours[:n] = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
        return colours[rows[:, :w]]
    return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _integral(image: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The integral image along the first axis at some ascending edges; between its grid points it is linear.

    Rows are added up strip by strip between neighbouring edges; an image of over ``COPY_BYTES`` isn't copied for that.
    """
    low = np.minimum(edges.astype(np.int64), len(image) - 1)
    if image.nbytes > COPY_BYTES:
        strips = np.stack([image[a:b].sum(axis=0, dtype=np.float64) for a, b in itertools.pairwise(low.tolist())])
    else:
        strips = np.add.reduceat(image, low, axis=0, dtype=np.float64)[:-1]
        strips[low[1:] == low[:-1]] = 0  # an empty strip
    total = np.concatenate([np.zeros((1, *image.shape[1:])), np.cumsum(strips, axis=0)])
    return total + image[low] * (edges - low).reshape(-1, *[1] * (image.ndim - 1))


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of each of height x width equal areas, by an integral image; edges inside a pixel are weighted.

    The integral image is interpolated linearly between its grid points, which is the exact integral of the image
    taken as constant in each pixel, so sizes need not divide, and small images may grow.  Beside the image itself only
    ``height`` of its rows are held, in doubles.
    """
    x = image
    for n in (height, width):
        x = np.swapaxes(np.diff(_integral(x, np.linspace(0, len(x), n + 1)), axis=0) * (n / len(x)), 0, 1)
    return x


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 9 area means is less than its right neighbour (means rounded to 1/1000)."""
    small = np.round(grey(area_resize(image, 8, 9)), 3)  # grey is linear, so it may come last
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray, side: int = TILE) -> bytes:
    """A side x side area-resized tile as the bytes of an NPY file."""
    return npy(np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 length and its bytes, filled up with spaces to a positive multiple of ``UNIT``."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def texts_to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a P6 image of width 64: doc_id, n_bytes, media.

    A null text counts as empty, and an empty one is one row of spaces; equal texts give equal media; repeated rows
    and null ids stay; an empty table gives no row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column("text"):
                n, payload = payload_of(text.as_py())
                sizes.append(n)
                media.append(encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_WIDTH, 3)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return storage.map_batches(docs.select(storage.col(id_col).cast("long").alias("doc_id"), storage.col(text_col).alias("text")), run, "doc_id long, n_bytes long, media binary")


_FEATURES = {
    "payload_bytes": (LongType(), pa.int64()), "payload_sha256": (StringType(), pa.string()), "tail_crc32": (LongType(), pa.int64()),
    "media_bytes": (LongType(), pa.int64()), "media_sha256": (StringType(), pa.string()), "feature": (StringType(), pa.string()),
    "height": (IntegerType(), pa.int32()), "width": (IntegerType(), pa.int32()), "tile": (BinaryType(), pa.binary()),
}


def media_features(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Decode a binary column and add payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    (difference hash), height, width and tile (NPY).

    Bytes that are null or no whole image give nulls in all of these but media_bytes and media_sha256 (null for null).
    Other columns of any names stay, but for those of the added names, whose place these take; repeated rows stay; an
    empty table gives no row.  An image is held about once as bytes, whatever its size; one may have up to 2 GB, as any value
    of a binary column.
    """
    kept = [f for f in media.schema.fields if f.name != media_col and f.name.lower() not in _FEATURES]
    schema = StructType([*kept, *(StructField(name, kind) for name, (kind, _) in _FEATURES.items())])

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 9
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            image = decode(data)
        except MediaError:
            return (None, None, None, *stored, None, None, None, None)
        payload = np.ascontiguousarray(image).reshape(-1)  # no copy
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, difference_hash(image), *image.shape[:2], tile(image))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [kind for _, kind in _FEATURES.values()], [*(f.name for f in kept), *_FEATURES]
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(media_col)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + columns, names=names)

    return storage.map_batches(media.select(*(storage.col(c) for c in [*(f.name for f in kept), media_col])), run, schema)


def stored_media(docs: DataFrame, **columns: str) -> DataFrame:
    """``texts_to_media`` written as a table in the shared folder, and read back."""
    return storage.materialize(texts_to_media(docs, **columns), "media")
