"""Media columns: Netpbm and BMP images in binary columns, their tiles and difference hashes."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import column_bytes

WIDTH = 64
TILE = 32
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
_LENGTH = re.compile(rb"\A.{2}\n# bytes (\d+)\n", re.S)


def encode_pgm(payload: bytes, n_bytes: int, width: int = WIDTH) -> bytes:
    """Binary greymap of a payload whose length is a multiple of ``width``; a comment holds ``n_bytes``."""
    return b"P5\n# bytes %d\n%d %d\n255\n" % (n_bytes, width, len(payload) // width) + payload


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette."""
    height, width = image.shape
    rows = np.zeros((height, (width + 3) // 4 * 4), np.uint8)
    rows[:, :width] = image[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    head = struct.pack("<2sIHHI", b"BM", 1078 + rows.size, 0, 0, 1078)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette.tobytes() + rows.tobytes()


def stored_length(media: bytes) -> int | None:
    """The ``n_bytes`` that ``encode_pgm`` noted."""
    found = _LENGTH.match(media[:40])
    return int(found[1]) if found else None


def _decode_netpbm(media: bytes) -> np.ndarray:
    kind, at, numbers = media[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        found = _TOKEN.match(media, at)
        if not found or len(found[1]) > 9:
            raise ValueError("netpbm: broken header")
        numbers.append(int(found[1]))
        at = found.end()
    if len(numbers) == 3 and not 0 < numbers[2] < 65536:
        raise ValueError("netpbm: greatest value out of range")
    width, height = numbers[:2]
    channels = 3 if kind in (3, 6) else 1
    if kind == 1:  # digits of a plain bitmap need no space between them
        bits = re.sub(rb"#[^\n]*|\s", b"", media[at:])
        return ((49 - np.frombuffer(bits, np.uint8, width * height)) * 255).astype(np.uint8).reshape(height, width)
    if kind in (2, 3):
        words = re.sub(rb"#[^\n]*", b"", media[at:]).split()[: width * height * channels]
        if max(map(len, words), default=0) > 5:
            raise ValueError("netpbm: sample out of range")
        samples = np.array(words, np.int64)
        if (samples > numbers[2]).any() or (samples < 0).any():
            raise ValueError("netpbm: sample out of range")
        image = (samples * 255 // numbers[2]).astype(np.uint8)
    elif kind == 4:
        packed = np.frombuffer(media, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        return ((1 - np.unpackbits(packed, axis=1)[:, :width]) * 255).astype(np.uint8)
    else:
        wide = numbers[2] > 255
        image = np.frombuffer(media, ">u2" if wide else np.uint8, width * height * channels, at + 1)
        if numbers[2] != 255:
            image = (np.minimum(image, numbers[2]).astype(np.int64) * 255 // numbers[2]).astype(np.uint8)
    return image.reshape((height, width, 3) if channels == 3 else (height, width))


def _decode_bmp(media: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", media, 10)[0]
    size, width, height, _, depth, packing = struct.unpack_from("<IiiHHI", media, 14)
    if depth not in (8, 24, 32) or packing:
        raise ValueError(f"bmp: {depth} bits with compression {packing} is not handled")
    stride, tall = (width * depth // 8 + 3) // 4 * 4, abs(height)
    rows = np.frombuffer(media, np.uint8, stride * tall, start).reshape(tall, stride)[:, : width * depth // 8]
    rows = rows[::-1] if height > 0 else rows
    if depth == 8:
        colours = struct.unpack_from("<I", media, 46)[0] or 256
        palette = np.frombuffer(media, np.uint8, colours * 4, 14 + size).reshape(-1, 4)
        image = palette[rows][:, :, 2::-1]
        return np.ascontiguousarray(image[:, :, 0]) if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else image
    return np.ascontiguousarray(rows.reshape(tall, width, depth // 8)[:, :, 2::-1])


def decode(media: bytes) -> np.ndarray:
    """Height x width (x 3) array of 8-bit samples."""
    if media[:1] == b"P" and media[1:2] in b"123456" and len(media) > 2:
        return _decode_netpbm(media)
    if media[:2] == b"BM":
        return _decode_bmp(media)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, from the integral image at the cells' (fractional) edges.

    Only the rows of the integral image that an edge falls on or beside are made, so a very tall
    image takes no more memory than its own samples.
    """
    if image.ndim == 3:
        image = (image @ np.array([299, 587, 114])) // 1000
    tall, wide = image.shape
    ys = np.arange(height + 1) * (tall / height)
    below = np.minimum(ys.astype(np.int64), tall - 1)
    needed = np.unique(np.concatenate([[0], below, below + 1]))
    strips = [image[a:b].sum(0, dtype=np.int64) for a, b in zip(needed[:-1], needed[1:], strict=True)]
    down = np.cumsum(np.vstack([np.zeros(wide, np.int64), *strips]), 0)
    integral = np.concatenate([np.zeros((len(needed), 1)), np.cumsum(down, 1)], 1)
    at = np.searchsorted(needed, below)
    part = (ys - below)[:, None]
    rows = integral[at] * (1 - part) + integral[at + 1] * part
    xs = np.arange(width + 1) * (wide / width)
    left = np.minimum(xs.astype(np.int64), wide - 1)
    cells = rows[:, left] * (1 - (xs - left)) + rows[:, left + 1] * (xs - left)
    return np.diff(np.diff(cells, axis=0), axis=1) / (tall / height * wide / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is a cell of the 8 x 9 thumbnail darker than its right neighbour."""
    small = area_resize(image, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the text's bytes as an 8-bit greymap 64 wide, in column ``media``.

    The UTF-8 bytes are padded with zeros up to a positive multiple of 64. Null counts as empty, whose
    image is one row of zeros. Repeated rows stay; other columns of ``docs`` don't matter.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            media = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                raw = data[a:b].tobytes()
                media.append(encode_pgm(raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0"), len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["id", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Decode each image: ``id_col``, height, width, ``samples`` (its 8-bit samples), ``n_bytes`` (where
    the image notes it), ``tile`` (an NPY file of 32 x 32) and ``dhash``.

    A null or undecodable image, or one without samples, gets nulls.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item in batch.column(1):
                raw = item.as_py()
                try:
                    image = decode(raw or b"")
                    if not image.size:
                        raise ValueError("no samples")
                except (ValueError, IndexError, OverflowError, MemoryError, struct.error):
                    out.append((None,) * 6)
                    continue
                out.append((*image.shape[:2], image.tobytes(), stored_length(raw), npy_tile(image), difference_hash(image)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["id", "height", "width", "samples", "n_bytes", "tile", "dhash"],
            )

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, height int, width int, samples binary, n_bytes bigint, tile binary, dhash string"
    return rows.mapInArrow(features, shape).withColumnRenamed("id", id_col)
