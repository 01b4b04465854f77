import hashlib
import io
import zlib

import numpy as np
import pytest

from factloom.llm import media, queries
from tests.llm.rows import table


@pytest.fixture
def image():
    return np.random.default_rng(5).integers(0, 256, (13, 7, 3), dtype=np.uint8)


def test_round_trips(image):
    assert (media.decode(media.encode_ppm(image)) == image).all()
    assert (media.decode(media.encode_bmp(image)) == image).all()
    assert (media.decode(media.encode_ppm(image[..., 0])) == image[..., 0]).all()


def test_plain_netpbm(image):
    text = "P3 # made by hand\n7 13\n255\n" + " ".join(map(str, image.ravel()))
    assert (media.decode(text.encode()) == image).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n\xa0\x40").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15 0 15").tolist() == [[0, 255]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]


def test_bmp_with_palette():
    import struct

    pixels = bytes([0, 1, 0, 0, 1, 0, 0, 0])
    raw = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 8, 0, 8, 0, 0, 2, 0) + bytes([1, 2, 3, 0, 9, 8, 7, 0]) + pixels
    assert media.decode(raw).tolist() == [[[7, 8, 9], [3, 2, 1]], [[3, 2, 1], [7, 8, 9]]]


@pytest.mark.parametrize("size", [(5, 3), (13, 7), (20, 31), (1, 1)])
def test_area_resize_equals_weights(image, size):
    def weights(n, m):
        w = np.zeros((m, n))
        for i in range(m):
            for j in range(n):
                w[i, j] = max(0, min((i + 1) * n / m, j + 1) - max(i * n / m, j)) * m / n
        return w

    want = np.einsum("ij,jkc,lk->ilc", weights(13, size[0]), image, weights(7, size[1]))
    assert np.abs(media.area_resize(image, *size) - want).max() <= 0.5 + 1e-6


def test_query_rows(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_media(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        stored = media.store_payload(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.difference_hash(media.decode(stored))


def test_awkward_media(spark, image):
    good = media.encode_bmp(image)
    rows = [(1, good), (2, None), (3, b""), (4, b"P6\n9 9\n255\nxx"), (5, good[:60]), (6, b"GIF89a"), (7, b"P6\n0 0\n255\n"), (None, good)]
    frame = spark.createDataFrame(rows, "doc_id long, media binary")
    got = {r.doc_id: r for r in media.media_columns(frame).collect()}
    assert got[1].dhash == got[None].dhash and got[1].error is None
    assert (np.load(io.BytesIO(got[1].tile_npy)) == media.area_resize(image, 32, 32)).all()
    assert got[2].error is None and got[2].samples is None
    assert all(got[i].error and got[i].samples is None for i in (3, 4, 5, 6, 7))
    assert media.media_columns(frame.limit(0)).count() == 0


def test_null_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    stored = table(spark).select("doc_id", media.text_media(F.col("text")).alias("media"), F.col("size").alias("height"))
    assert all(r.error is None for r in media.media_columns(stored).collect())


def test_malformed_media_gives_an_error(spark, image):
    import struct

    bmp = media.encode_bmp(image)
    masks = lambda r, g, b: struct.pack("<2sIHHI", b"BM", 0, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 32, 3, 4, 0, 0, 0, 0) + struct.pack("<III", r, g, b) + bytes([1, 2, 3, 0])
    bad = [
        b"P5 99999999999999999999 1 255\n" + b"x" * 50, b"P5 4294967296 4294967296 255\n" + b"x" * 50, b"P2 1 1 255 99999999999999999999", b"P2 2 1 15 16 0", b"P2 1 1 255 -3", b"P5 1 1 0\nx", b"P5 1 1 70000\nxx",
        b"P1 2 1 1 7", b"P6 1 1 100\n\xff\xff\xff", b"P5 " + b"9" * 5000, masks(0xFF, 0xFF00, 0xFF0000), bmp[:18] + struct.pack("<i", -7) + bmp[22:], bmp[:18] + struct.pack("<i", 2**31 - 1) + bmp[22:], bmp[:22] + struct.pack("<i", 0) + bmp[26:], bmp[:10] + b"\xff\xff\xff\xff" + bmp[14:],
    ]
    frame = spark.createDataFrame(list(enumerate(bad)), "doc_id long, media binary")
    got = media.media_columns(frame).collect()
    assert [r.doc_id for r in got if not r.error or r.samples is not None] == []
    assert media.decode(masks(0xFF0000, 0xFF00, 0xFF)).tolist() == [[[3, 2, 1]]]


def test_noise_never_fails():
    import random
    import struct

    chance = random.Random(9)
    for i in range(3000):
        raw = bytearray(chance.choice([b"P1 ", b"P2 3 2 9 ", b"P3 1 1 255 ", b"P4 9 9\n", b"P5 2 2 255\n", b"P6 1 2 300\n", media.encode_bmp(np.zeros((3, 2, 3), np.uint8))]) + chance.randbytes(chance.randint(0, 60)))
        for _ in range(chance.randint(0, 6)):
            raw[chance.randrange(2, len(raw))] = chance.choice(b"0123456789 \n#\x00\xff")
        try:
            shape = media.decode(bytes(raw)).shape
        except (ValueError, OverflowError, struct.error, IndexError):
            continue
        assert np.prod(shape) <= 8 * 256 * len(raw), i


def test_resizing_in_strips(image, monkeypatch):
    whole = [media.area_resize(image, 5, 3), media.area_resize(image[:1], 4, 4), media.area_resize(image[:, :2], 9, 9)]
    hashed = media.grey(image)
    monkeypatch.setattr(media, "STRIP", 16)
    parts = [media.area_resize(image, 5, 3), media.area_resize(image[:1], 4, 4), media.area_resize(image[:, :2], 9, 9)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and (media.grey(image) == hashed).all()
