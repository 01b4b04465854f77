"""Media columns: Netpbm and BMP images as numpy arrays, NPY tiles and difference hashes.

``decode`` reads PBM, PGM and PPM (plain and raw) and uncompressed BMP of 8, 24 and 32 bits into an
array of 8-bit samples. ``area_resize`` averages areas exactly by differences of an integral image.
A tile is the resized image as an NPY file; the difference hash compares neighbours of a 9 by 8
grey tile.

Cases: null media gives null results; bytes that are no supported image give null results too, with
``error`` saying why (cut short, sizes beyond the bytes given, samples above the maximum, a maximum
that is not 1 to 65535, channel masks in another order); repeated rows get equal values; an empty
table gives an empty table; other columns are not looked at. Heights and widths are only bounded by
the bytes given; resizing works in strips, so beside the samples it holds a fraction of them.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import slices

#: Row width of stored payloads: 64 pixels of 3 samples.
WIDTH, SAMPLES = 64, 3
UNIT = WIDTH * SAMPLES
#: Samples that are widened at once.
STRIP = 1 << 20


def encode_ppm(image: np.ndarray) -> bytes:
    """A raw PPM (three samples) or PGM (one)."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return kind + f"\n{image.shape[1]} {image.shape[0]}\n255\n".encode() + image.astype(np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """A 24-bit BMP, rows from the bottom up."""
    h, w, _ = image.shape
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = image[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(raw: bytes) -> np.ndarray:
    kind, at = raw[1] - 48, 2
    header: list[int] = []
    while len(header) < (2 if kind in (1, 4) else 3):
        found = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(raw, at)
        if not found:
            raise ValueError("Netpbm header is cut short")
        header.append(int(found[1]))
        at = found.end()
    w, h, most = [*header, 1][:3]
    depth = 3 if kind in (3, 6) else 1
    if not 0 < most < 65536:
        raise ValueError("the maximum of Netpbm samples is not 1 to 65535")
    # each sample takes a byte at least, or a bit; so no size is taken on trust
    if w * h * depth > (8 if kind == 4 else 1) * len(raw):
        raise ValueError("Netpbm samples are cut short")
    if kind == 1:
        values = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", raw[at:]), np.uint8)[: w * h] - 48
    elif kind < 4:
        values = np.array(raw[at:].split()[: w * h * depth], np.int64)
    elif kind == 4:
        line = -(-w // 8)
        values = np.unpackbits(np.frombuffer(raw, np.uint8, line * h, at + 1).reshape(h, line), axis=1)[:, :w]
    else:
        values = np.frombuffer(raw, ">u2" if most > 255 else np.uint8, w * h * depth, at + 1)
    if values.size != w * h * depth:
        raise ValueError("Netpbm samples are cut short")
    if values.size and not 0 <= int(values.min()) <= int(values.max()) <= most:
        raise ValueError("Netpbm samples exceed their maximum")
    if kind in (1, 4):
        values = (1 - values.astype(np.int64)) * 255  # a set bit is black
    elif most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // most
    return values.astype(np.uint8).reshape((h, w, 3) if depth == 3 else (h, w))


def _bmp(raw: bytes) -> np.ndarray:
    start, head, w, h = struct.unpack_from("<I", raw, 10)[0], *struct.unpack_from("<Iii", raw, 14)
    bits, packed = struct.unpack_from("<HI", raw, 28)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 and 32 bits")
    if w <= 0:
        raise ValueError("a BMP without columns")
    if packed == 3 and (bits != 32 or struct.unpack_from("<III", raw, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("BMP channel masks in another order than blue, green, red")
    line, n = -(-w * bits // 32) * 4, abs(h)
    rows = np.frombuffer(raw, np.uint8, line * n, start).reshape(n, line)[:, : w * bits // 8]
    if h > 0:
        rows = rows[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", raw, 46)[0] or 256
        table = np.frombuffer(raw, np.uint8, used * 4, 14 + head).reshape(used, 4)
        return np.ascontiguousarray(table[rows][..., 2::-1])
    return np.ascontiguousarray(rows.reshape(n, w, bits // 8)[..., 2::-1])


def decode(raw: bytes) -> np.ndarray:
    """Samples of an image file: (height, width) or (height, width, 3), 8 bits."""
    if raw[:1] == b"P" and raw[1:2] in b"123456" and len(raw) > 2:
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise ValueError("neither Netpbm nor BMP")


def _along(values: np.ndarray, size: int) -> np.ndarray:
    """Means of ``size`` equal parts of the first axis, by differences of running sums, in strips."""
    n, other = values.shape[0], values.shape[1:]
    out, edge = np.empty((size, *other)), np.arange(size + 1) * n
    step = max(1, STRIP // max(1, int(np.prod(other)) * -(-n // size)))
    for i in range(0, size, step):
        j = min(size, i + step)
        low, high = edge[i] // size, -(-edge[j] // size)
        whole = np.concatenate([np.zeros((1, *other)), np.cumsum(values[low:high], axis=0, dtype=np.float64)])
        at, part = edge[i : j + 1] // size - low, (edge[i : j + 1] % size / size).reshape(-1, *[1] * len(other))
        sums = whole[at] + part * (whole[np.minimum(at + 1, high - low)] - whole[at])
        out[i:j] = np.diff(sums, axis=0) * (size / n)
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each target pixel covers, fractions of pixels included. The longer axis
    goes first, so what lies between is small."""
    samples = image.reshape(image.shape[0], image.shape[1], -1)
    if image.shape[0] >= image.shape[1]:
        small = _along(_along(samples, height).swapaxes(0, 1), width).swapaxes(0, 1)
    else:
        small = _along(_along(samples.swapaxes(0, 1), width).swapaxes(0, 1), height)
    return np.clip(np.rint(np.round(small, 6)), 0, 255).astype(np.uint8).reshape((height, width) if image.ndim == 2 else (height, width, -1))


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    pixels, out = image.reshape(-1, 3), np.empty(image.shape[0] * image.shape[1], np.uint8)
    for i in range(0, len(out), STRIP):
        out[i : i + STRIP] = (pixels[i : i + STRIP].astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000
    return out.reshape(image.shape[:2])


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hexadecimal: is a pixel of the 9 by 8 grey tile darker than its right neighbour?"""
    tile = area_resize(grey(image), 8, 9)
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def store_payload(payload: bytes) -> bytes:
    """A payload of a positive multiple of ``UNIT`` bytes as the samples of a raw PPM."""
    return encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, SAMPLES))


def text_media(text: Column) -> Column:
    """Texts as images, with Spark functions only: UTF-8 (null: empty) filled with blanks to a
    positive multiple of ``UNIT`` bytes, behind a raw PPM header."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / UNIT).cast("int"))
    fill = F.encode(F.repeat(F.lit(" "), (rows * UNIT - F.octet_length(raw)).cast("int")), "UTF-8")
    return F.concat(F.encode(F.concat(F.lit(f"P6\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8"), raw, fill)


def media_columns(table: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",), tile: tuple[int, int] = (32, 32)) -> DataFrame:
    """Decode the ``media`` column and compute features: ``keep`` and height, width, samples (bytes,
    the decoded array), tile_npy (bytes), dhash and error. A narrow map without a shuffle."""
    chosen = table.select(*[table[c] for c in keep], table[media].cast("binary").alias("__media"))
    fields = [("height", T.IntegerType()), ("width", T.IntegerType()), ("samples", T.BinaryType()), ("tile_npy", T.BinaryType()), ("dhash", T.StringType()), ("error", T.StringType())]
    schema = T.StructType([*chosen.schema.fields[:-1], *(T.StructField(n, t) for n, t in fields)])
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 6
        try:
            image = decode(raw)
        except (ValueError, OverflowError, struct.error, IndexError) as e:
            return *(None,) * 5, str(e)[:200]
        if not image.size:
            return *(None,) * 5, "an image without samples"
        return image.shape[0], image.shape[1], image.tobytes(), npy(area_resize(image, *tile)), difference_hash(image), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep)):
                rows = [one(raw) for raw in part.column(len(keep)).to_pylist()]
                made = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=schema.names)

    return chosen.mapInArrow(run, schema)
