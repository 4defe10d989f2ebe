"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized copies, NPY tiles and difference hashes.

Decoders take binary PBM/PGM/PPM (P4, P5, P6 with 8-bit samples) and uncompressed 8- and 24-bit BMP. Area resizing reads
an integral image at the cell borders only, so memory is that of the output however tall the image is. A tile is the
array in NPY format 1.0.

Defined results: null or undecodable media give null columns in `decode_media`; an empty or null text is stored as one
row of zero samples by `text_media`; repeated rows give repeated results; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import ast
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

MAGIC = b"\x93NUMPY\x01\x00"


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def decode_netpbm(raw: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) uint8 samples of a binary Netpbm image."""
    kind = raw[:2]
    if kind not in (b"P4", b"P5", b"P6"):
        raise ValueError("not a binary Netpbm image")
    fields, at = [], 2
    while len(fields) < (2 if kind == b"P4" else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(raw, at)
        if not m:
            raise ValueError("truncated header")
        fields.append(int(m[1]))
        at = m.end()
    at += 1
    w, h = fields[:2]
    if kind == b"P4":
        rows = np.frombuffer(raw, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255)
    if fields[2] != 255:
        raise ValueError("only 8-bit samples")
    n = 3 if kind == b"P6" else 1
    out = np.frombuffer(raw, np.uint8, h * w * n, at)
    return out.reshape(h, w, 3) if n == 3 else out.reshape(h, w)


def decode_bmp(raw: bytes) -> np.ndarray:
    """(height, width, 3) RGB samples of an uncompressed 24-bit or palette 8-bit BMP."""
    if raw[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head, w, h = struct.unpack_from("<IIii", raw, 10)
    bits, packed = struct.unpack_from("<HI", raw, 28)
    if packed or bits not in (8, 24):
        raise ValueError("unsupported BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    if h > 0:
        rows = rows[::-1]
    if bits == 24:
        return rows[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
    colours = struct.unpack_from("<I", raw, 46)[0] or 256
    palette = np.frombuffer(raw, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)
    return palette[rows[:, :w]][:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def npy_bytes(image: np.ndarray) -> bytes:
    shape = "(%s)" % ", ".join(map(str, image.shape))
    head = "{'descr': '|u1', 'fortran_order': False, 'shape': %s, }" % shape
    head += " " * (-(len(MAGIC) + 2 + len(head) + 1) % 64) + "\n"
    return MAGIC + struct.pack("<H", len(head)) + head.encode() + np.ascontiguousarray(image).tobytes()


def read_npy(raw: bytes) -> np.ndarray:
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not an NPY tile")
    n = struct.unpack_from("<H", raw, len(MAGIC))[0]
    head = ast.literal_eval(raw[len(MAGIC) + 2 : len(MAGIC) + 2 + n].decode().strip())
    return np.frombuffer(raw, np.uint8, -1, len(MAGIC) + 2 + n).reshape(head["shape"])


def _integral_rows(image: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the rows above each (fractional) cut: the integral image's first axis, at the cuts only."""
    whole = np.floor(cuts).astype(np.int64)
    borders = np.unique(np.concatenate([[0], whole, [image.shape[0]]]))
    blocks = np.add.reduceat(image, borders[:-1], axis=0, dtype=np.int64) if len(borders) > 1 else np.zeros((0, image.shape[1]), np.int64)
    above = np.vstack([np.zeros((1, image.shape[1]), np.int64), np.cumsum(blocks, axis=0)])
    out = above[np.searchsorted(borders, whole)].astype(np.float64)
    part = cuts - whole
    inner = part > 0
    out[inner] += part[inner, None] * image[whole[inner]]
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's exact area, (height, width) floats, of a 2-D image."""
    h, w = image.shape
    rows = _integral_rows(image, np.arange(height + 1) * (h / height))
    strips = np.diff(rows, axis=0)
    integral = np.concatenate([np.zeros((height, 1)), np.cumsum(strips, axis=1)], axis=1)
    cuts = np.arange(width + 1) * (w / width)
    cells = np.empty((height, width + 1))
    for i in range(height):
        cells[i] = np.interp(cuts, np.arange(w + 1), integral[i])
    return np.diff(cells, axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, hex: is each cell of an 8 x 9 reduction darker than its right neighbour."""
    grey = image if image.ndim == 2 else np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    small = np.rint(area_resize(grey, 8, 9) * 256)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def decode_media(df: DataFrame, column: str, key: str, tile: int = 64) -> DataFrame:
    """(key, height, width, tile, dhash) of a binary column of images: `tile` is an area-resized NPY tile.

    Nulls, empty and broken images have a key only; rows that repeat repeat. Images are decoded one after another, and come
    in Arrow batches of BATCH_ROWS rows and of spark.sql.execution.arrow.maxBytesPerBatch at most.
    """

    def run(batches):
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = {"key": k, "height": None, "width": None, "tile": None, "dhash": None}
                try:
                    image = decode(raw.as_py() or b"")
                    if 0 in image.shape:
                        raise ValueError("empty image")
                    grey = image if image.ndim == 2 else np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
                    small = np.rint(area_resize(grey, tile, tile)).astype(np.uint8)
                    row |= {"height": image.shape[0], "width": image.shape[1], "tile": npy_bytes(small), "dhash": difference_hash(image)}
                except (ValueError, struct.error, IndexError):
                    pass
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string())]))

    arrow_batches(df.sparkSession)
    return df.select(F.col(key).cast("long"), F.col(column).cast("binary")).mapInArrow(run, "key long, height int, width int, tile binary, dhash string")


def text_media(docs: DataFrame, width: int = 64, with_tiles: bool = True) -> DataFrame:
    """Each whole text as an 8-bit grey image of `width` samples a row: PGM bytes decoded, stored as an NPY tile, read back.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, tile]): the payload
    columns are computed from what the stored tile gives back; feature is the difference hash.
    """

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                payload = raw + b"\0" * (-len(raw) % width or (0 if raw else width))
                image = decode_netpbm(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, width)))
                tile = npy_bytes(image)
                back = read_npy(tile)
                samples = back.tobytes()
                row = (
                    doc, len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]),
                    len(tile), hashlib.sha256(tile).hexdigest(), difference_hash(back), tile,
                )
                for n, v in zip(names, row):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds)})

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"][: 9 if with_tiles else 8]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, ["long", "long", "long", "string", "long", "long", "string", "string", "binary"]))
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)
