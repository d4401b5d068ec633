import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

from tidewatch.llm import media


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (17, 9)])
def test_formats_round_trip(shape):
    rng = np.random.default_rng(1)
    grey, rgb = rng.integers(0, 256, shape).astype(np.uint8), rng.integers(0, 256, (*shape, 3)).astype(np.uint8)
    assert np.array_equal(media.decode(media.encode_pgm(grey)), grey)
    assert np.array_equal(media.decode(media.encode_bmp(grey)), grey)
    assert np.array_equal(media.decode(media.encode_bmp(rgb)), rgb)
    h, w = shape
    assert np.array_equal(media.decode(b"P2 # note\n%d %d\n255\n" % (w, h) + b" ".join(b"%d" % v for v in grey.ravel())), grey)
    assert np.array_equal(media.decode(b"P6\n%d %d 255\n" % (w, h) + rgb.tobytes()), rgb)
    bits = (grey > 127).astype(np.uint8)
    assert np.array_equal(media.decode(b"P4\n%d %d\n" % (w, h) + np.packbits(1 - bits, axis=1).tobytes()), bits)
    assert np.array_equal(media.decode(b"P1\n%d %d\n" % (w, h) + b"".join(b"%d" % (1 - v) for v in bits.ravel())), bits)
    wide = grey.astype(">u2") * 257
    assert np.array_equal(media.decode(b"P5\n%d %d\n65535\n" % (w, h) + wide.tobytes()), wide)


def test_bmp_runs():
    import struct

    data = bytes([3, 7, 0, 0, 0, 3, 1, 2, 3, 0, 0, 1])
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256))
    head = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54 + 1024) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 8, 1, len(data), 0, 0, 256, 0)
    assert media.decode(head + palette + data).tolist() == [[1, 2, 3], [7, 7, 7]]


@pytest.mark.parametrize("bad", [b"", b"P5", b"P5\n2 2\n255\nx", b"BM", b"GIF89a", b"P5\n0 1\n255\n"])
def test_undecodable_is_reported(spark, bad):
    row = media.describe_media(spark.createDataFrame([(1, bytearray(bad))], "id long, media binary"), ["id"]).first()
    assert row["error"] and row["dhash"] is None and row["tile"] is None


def test_area_resize_is_the_mean_of_areas():
    x = np.random.default_rng(2).random((6, 9))
    assert np.allclose(media.area_resize(x, 3, 3), x.reshape(3, 2, 3, 3).mean((1, 3)))
    assert np.allclose(media.area_resize(x, 6, 9), x)
    fine = np.kron(x, np.ones((4, 5)))
    assert np.allclose(media.area_resize(x, 4, 5), fine.reshape(4, 6, 5, 9).mean((1, 3)))


def test_null_media(spark):
    row = media.describe_media(spark.createDataFrame([(1, None)], "id long, media binary"), ["id"]).first()
    assert row["error"] == "no media"


def check(docs, rows):
    texts = sorted(((-1 if d["doc_id"] is None else d["doc_id"], d["text"] or "") for d in docs.collect()))
    want = []
    for i, t in texts:
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows)
    assert got == sorted(want)


def test_query_is_lossless(spark):
    rows = media.op1_media(spark, SF).collect()
    check(spark.read.parquet(f"{SF}/documents.parquet"), rows)
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"], r["tile_sha256"]) for r in rows}) == len({r["payload_sha256"] for r in rows})


def test_odd_documents(spark, odd_documents, no_documents):
    made = media.describe_media(media.texts_to_media(odd_documents), ["doc_id", "n_bytes"])
    check(odd_documents, made.collect())
    assert media.describe_media(media.texts_to_media(no_documents), ["doc_id", "n_bytes"]).count() == 0


def test_tiles_are_npy(spark, odd_documents, tmp_path):
    media.write_tiles(media.describe_media(media.texts_to_media(odd_documents), ["doc_id"]), str(tmp_path / "t"))
    tiles = spark.read.parquet(str(tmp_path / "t")).select(F.col("tile")).collect()
    assert len(tiles) == 14 and all(np.load(io.BytesIO(bytes(r[0]))).shape == (16, 16) for r in tiles)


def test_broken_media_give_errors(spark):
    big = 10**11
    rle = struct.pack("<2sIHHI", b"BM", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2**30, 2**30, 1, 8, 1, 0, 0, 0, 0, 0)
    broken = [
        b"P2 1 1 255 300", b"P2 1 1 255 -3", b"P2 1 1 255 x", b"P4 %d %d 0" % (big, big), b"P5 %d %d 255 0" % (big, big), b"P1 2 1 1 7", rle,
        b"P6 2 2 255 ab", b"", b"BM", b"BM" + bytes(52), rle[:14] + struct.pack("<IiiHHIIiiII", 40, 5, 5, 1, 3, 0, 0, 0, 0, 0, 0), b"P5 " + b"9" * 5000,
    ]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(broken)], "id long, media binary")
    rows = media.describe_media(df, ["id"]).collect()
    assert len(rows) == len(broken) and all(r["error"] and r["height"] is None and r["tile"] is None for r in rows)
