"""Media columns: Netpbm and BMP images decoded to numpy arrays, resized, hashed and tiled.

Images are decoded by hand (P1 to P6 at 8 or 16 bits; BMP of 1, 4, 8, 16, 24 and 32 bits,
uncompressed, bit fields or RLE8), resized by exact area averages taken from an integral image,
and given a 64-bit difference hash.  The resized tile is kept as NPY bytes.

Defined cases: null or undecodable media give null shape, hash and tile and an error text, also where the
header declares more pixels than the bytes can hold (or runs more than MAX_RLE_PIXELS); a null
text is stored as an empty one (one row of 64 zero samples); repeated rows give repeated rows;
columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import row_groups, shared_dir, table

WIDTH = 64
#: Pixels that a BMP image of runs may declare; larger ones give an error text.
MAX_RLE_PIXELS = 1 << 26

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary 8-bit PGM of a matrix."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed BMP: 8-bit grey of a matrix, 24-bit of an (h, w, 3) RGB array."""
    h, w = pixels.shape[:2]
    bits = 8 if pixels.ndim == 2 else 24
    stride = (w * bits + 31) // 32 * 4
    rows = np.zeros((h, stride), np.uint8)
    flat = pixels[::-1] if bits == 8 else pixels[::-1, :, ::-1]
    rows[:, : w * bits // 8] = flat.reshape(h, -1)
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if bits == 8 else np.zeros((0, 4), np.uint8)
    at = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, rows.size, 2835, 2835, len(palette), 0)
    return head + palette.tobytes() + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) array; bitmaps come as 0 (black) and 1."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("short header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    top = head[2] if len(head) > 2 else 1
    if w < 1 or h < 1 or not 0 < top < 65536:
        raise ValueError("bad header")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * depth
    if n > 8 * len(data):  # a sample takes a bit at least
        raise ValueError("short raster")
    if kind == b"P1":
        bits = re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:n]
        if bits.strip(b"01"):
            raise ValueError("bad sample")
        out = 1 - (np.frombuffer(bits, np.uint8) - 48)
    elif kind in (b"P2", b"P3"):
        values = re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n]
        if any(len(v) > 5 or not v.isdigit() or int(v) > top for v in values):
            raise ValueError("bad sample")
        out = np.array(values, np.uint8 if top < 256 else np.uint16)
    elif kind == b"P4":
        stride = (w + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * h, at + 1).reshape(h, stride)
        out = 1 - np.unpackbits(rows, axis=1)[:, :w].reshape(-1)
    else:
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if out.size != n:
        raise ValueError("short raster")
    return out.reshape((h, w, 3) if depth == 3 else (h, w))


def _rle8(data: bytes, w: int, h: int) -> np.ndarray:
    out, x, y, at = np.zeros((h, w), np.uint8), 0, 0, 0
    while at + 1 < len(data) and y < h:
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            out[y, x : x + n] = v
            x += n
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            run = np.frombuffer(data, np.uint8, v, at)
            out[y, x : x + v] = run[: max(0, w - x)]
            x, at = x + v, at + v + v % 2
    return out


def _field(v: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(v.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    return ((v & mask) >> shift).astype(np.uint64) * 255 // (mask >> shift)


def decode_bmp(data: bytes) -> np.ndarray:
    """(h, w) of grey palettes, else (h, w, 3) RGB."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    at, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packing, _, _, _, used = struct.unpack_from("<iiHHIIiiI", data, 18)
    flip, h = h > 0, abs(h)
    if w < 1 or h < 1 or packing not in (0, 1, 3) or bits not in (1, 4, 8, 16, 24, 32) or (packing == 1 and bits != 8):
        raise ValueError("bad header")
    if w * h > (MAX_RLE_PIXELS if packing == 1 else 8 * len(data)):  # runs may end early, so their bytes tell nothing
        raise ValueError("image too large for its bytes" if packing != 1 else f"more than {MAX_RLE_PIXELS} pixels by runs")
    stride = (w * bits + 31) // 32 * 4
    if packing == 1:
        rows = _rle8(data[at:], w, h)
    else:
        rows = np.frombuffer(data, np.uint8, stride * h, at).reshape(h, stride)
    if bits <= 8:
        if packing != 1:
            per = np.unpackbits(rows, axis=1).reshape(h, -1, bits) if bits < 8 else None
            rows = rows[:, :w] if per is None else (per @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, :w]
        palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + head).reshape(-1, 4)[:, 2::-1]
        out = palette[rows]
        if (palette[:, :1] == palette).all():
            out = out[:, :, 0]
    elif bits == 24:
        out = rows[:, : 3 * w].reshape(h, w, 3)[:, :, ::-1]
    else:
        v = np.ascontiguousarray(rows[:, : w * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.uint32)
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else ((0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF))
        out = np.stack([_field(v, m) for m in masks], -1).astype(np.uint8)
    return out[::-1] if flip else out


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages of a grey image: differences of its integral image, taken at fractional edges."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, 0, np.float64), 1, out=total[1:, 1:])
    y, x = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    iy, ix = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    fy, fx = (y - iy)[:, None], x - ix
    rows = total[iy] * (1 - fy) + total[iy + 1] * fy
    at = rows[:, ix] * (1 - fx) + rows[:, ix + 1] * fx
    return np.diff(np.diff(at, axis=0), axis=1) * (height * width / (h * w))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: is each of 8 x 8 cells darker than its right neighbour."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(grey(image), side, side)).clip(0, 65535).astype(np.uint16 if image.dtype.itemsize > 1 else np.uint8))
    return out.getvalue()


def texts_to_media(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with zeros, as rows of a PGM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, hi in row_groups(len(t or "") for t in texts.to_pylist()):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts.slice(lo, hi - lo).to_pylist()]
                media = [encode_pgm(np.frombuffer(r + bytes(-len(r) % width if r else width), np.uint8).reshape(-1, width)) for r in raw]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_DESCRIBED = {
    "height": "int", "width": "int", "channels": "int", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long",
    "media_bytes": "long", "media_sha256": "string", "dhash": "string", "tile": "binary", "error": "string",
}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def describe_media(df: DataFrame, keep: list[str], media_col: str = "media", tile_side: int = 16) -> DataFrame:
    """The kept columns, and height, width, channels, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, dhash, tile, error.

    The payload is the decoded raster's bytes in row order.
    """

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 10 + ("no media",)
        held = (len(media), hashlib.sha256(media).hexdigest())
        try:
            image = decode(media)
        except (ValueError, struct.error, IndexError, OverflowError) as e:
            return (None,) * 6 + held + (None, None, str(e) or "undecodable")
        raw = np.ascontiguousarray(image).tobytes()
        return (image.shape[0], image.shape[1], image.shape[2] if image.ndim == 3 else 1, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), *held, difference_hash(image), npy_tile(image, tile_side), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = zip(*(one(m.as_py()) for m in b.column(len(keep))), strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, _ARROW[t]) for c, t in zip(cols, _DESCRIBED.values(), strict=True))], [*keep, *_DESCRIBED])

    chosen = df.select(*keep, media_col)
    schema = ", ".join([*(f"`{k}` {t}" for k, t in chosen.dtypes[: len(keep)]), *(f"{k} {t}" for k, t in _DESCRIBED.items())])
    return chosen.mapInArrow(run, schema)


def write_tiles(described: DataFrame, path: str) -> None:
    """NPY tiles with their hashes as Parquet, one row an image."""
    described.where("tile is not null").select(described.columns[0], "dhash", "tile").write.parquet(path)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as a PGM, written and read back, with its hash as the feature and the digest of its NPY tile."""
    path = shared_dir(spark)
    texts_to_media(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    described = describe_media(spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path), ["doc_id", "n_bytes"])
    return described.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("dhash").alias("feature"),
        F.sha2("tile", 256).alias("tile_sha256"),
    )
