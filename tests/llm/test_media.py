import hashlib
import struct
import zlib

import numpy as np
import pytest

from lakeseek.llm import media as M


def plain_resize(image, h, w):
    """Mean over each cell by fractional overlap, cell by cell."""
    out = np.zeros((h, w))
    H, W = image.shape
    for i in range(h):
        for j in range(w):
            y0, y1, x0, x1 = i * H / h, (i + 1) * H / h, j * W / w, (j + 1) * W / w
            s = 0.0
            for y in range(int(y0), min(H, int(np.ceil(y1)))):
                for x in range(int(x0), min(W, int(np.ceil(x1)))):
                    s += image[y, x] * max(0, min(y + 1, y1) - max(y, y0)) * max(0, min(x + 1, x1) - max(x, x0))
            out[i, j] = s / ((y1 - y0) * (x1 - x0))
    return out


@pytest.mark.parametrize("shape,to", [((1, 64), (8, 9)), ((5, 7), (3, 2)), ((40, 64), (8, 9)), ((3, 3), (6, 6)), ((17, 64), (17, 64))])
def test_area_resize(shape, to):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert np.allclose(M.area_resize(image, *to), plain_resize(image.astype(float), *to))


def test_formats():
    rng = np.random.default_rng(2)
    grey, rgb = rng.integers(0, 256, (5, 6)).astype(np.uint8), rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    assert np.array_equal(M.decode(M.encode_pgm(grey)), grey)
    assert np.array_equal(M.decode(b"P6 # note\n6 5\n255\n" + rgb.tobytes()), rgb)
    bits = rng.integers(0, 2, (3, 10)).astype(np.uint8)
    assert np.array_equal(M.decode(b"P4\n10 3\n" + np.packbits(bits, axis=1).tobytes()), (1 - bits) * 255)
    rows = b"".join(rgb[y, :, ::-1].tobytes() + b"\0" * (-18 % 4) for y in range(4, -1, -1))
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 6, 5, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert np.array_equal(M.decode(bmp), rgb)
    palette = rng.integers(0, 256, (4, 4)).astype(np.uint8)
    index = rng.integers(0, 4, (2, 5)).astype(np.uint8)
    rows = b"".join(index[y].tobytes() + b"\0" * 3 for y in (0, 1))
    bmp = b"BM" + struct.pack("<IHHI", 54 + 16 + len(rows), 0, 0, 70) + struct.pack("<IiiHHIIiiII", 40, 5, -2, 1, 8, 0, len(rows), 0, 0, 4, 0) + palette.tobytes() + rows
    assert np.array_equal(M.decode(bmp), palette[index][:, :, 2::-1])
    assert np.array_equal(M.read_npy(M.npy_bytes(grey)), grey) and len(M.npy_bytes(grey)) % 64 == grey.size % 64
    import io

    assert np.array_equal(np.load(io.BytesIO(M.npy_bytes(rgb))), rgb)
    for bad in (b"", b"P5", b"P5\n2 2\n255\nab", b"BM", b"xx"):
        with pytest.raises((ValueError, struct.error)):
            M.decode(bad)


def test_difference_hash():
    ramp = np.tile(np.arange(64, dtype=np.uint8), (8, 1))
    assert M.difference_hash(ramp) == "f" * 16 and M.difference_hash(ramp[:, ::-1]) == "0" * 16 and M.difference_hash(np.zeros((1, 64), np.uint8)) == "0" * 16


def test_texts_are_read_back(spark):
    texts = [None, "", "a" * 64, "é" * 33, "long " * 50_000, "\0x", "é" * 33]
    df = spark.createDataFrame([(i if i else None, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r.doc_id or 0: r for r in M.text_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert M.read_npy(bytes(r.tile)).tobytes() == payload and (r.media_bytes, r.media_sha256) == (len(r.tile), hashlib.sha256(r.tile).hexdigest())
    assert got[3].feature == got[6].feature and M.text_media(df.limit(0)).count() == 0


def test_media_column(spark):
    grey = np.arange(100, dtype=np.uint8).reshape(10, 10)
    df = spark.createDataFrame([(1, bytearray(M.encode_pgm(grey))), (2, None), (3, bytearray(b"junk")), (None, bytearray(M.encode_pgm(grey)))], "id long, raw binary")
    got = {r.key: r for r in M.decode_media(df, "raw", "id", 4).collect()}
    assert np.array_equal(M.read_npy(bytes(got[1].tile)), np.rint(plain_resize(grey.astype(float), 4, 4)).astype(np.uint8))
    assert got[2].tile is None and got[3].dhash is None and got[None].dhash == got[1].dhash and (got[1].height, got[1].width) == (10, 10)
