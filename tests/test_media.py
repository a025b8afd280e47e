import io
import wave

import numpy as np

from quillgraph.operators import media


def wav(y, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((y * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_png_round_trip_with_every_filter():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (10, 7, 3), dtype=np.uint8)
    assert (media.pixels(media.png_bytes(x)) == x).all()
    flat, raw = x.reshape(10, -1).astype(int), b""
    for y in range(10):
        kind, up = y % 5, flat[y - 1] if y else np.zeros(21, int)
        left, corner = np.concatenate([[0] * 3, flat[y][:-3]]), np.concatenate([[0] * 3, up[:-3]])
        paeth = [min((a, b, c), key=lambda v: abs(a + b - c - v)) for a, b, c in zip(left.tolist(), up.tolist(), corner.tolist(), strict=True)]
        base = [np.zeros(21, int), left, up, (left + up) // 2, np.array(paeth)][kind]
        raw += bytes([kind]) + ((flat[y] - base) & 255).astype(np.uint8).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert (media.pixels(data) == x).all()


def test_images(spark):
    half = np.zeros((16, 24, 1), np.uint8)
    half[:, 12:] = 200
    pnm = b"P5 4 2 255\n" + bytes(range(8))
    df = spark.createDataFrame([("a", bytearray(media.png_bytes(half))), ("b", bytearray(pnm)), ("c", bytearray(b"no image")), ("d", None)], "path string, content binary")
    got = {r["doc"]: r for r in media.image_chunks(df, "path", "content").collect()}
    assert got["a"]["perceptual_hash"] == "0f" * 8 and (got["a"]["width"], got["a"]["height"]) == (24, 16) and got["a"]["histogram"] == [0.5] + [0.0] * 7
    assert got["b"]["error"] is None and got["c"]["error"] and got["c"]["content"] is None and got["d"]["error"]
    tiles = sorted((r["chunk_index"], r["start_pos"], r["width"], r["height"]) for r in media.image_chunks(df.where("path = 'a'"), "path", "content", tile=10).collect())
    assert tiles == [(0, 0, 10, 10), (1, 10, 10, 10), (2, 20, 4, 10), (3, 240, 10, 6), (4, 250, 10, 6), (5, 260, 4, 6)]
    assert media.shrunk(np.arange(16.0).reshape(4, 4), 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]


def test_sound(spark):
    t = np.arange(8000 * 31) / 8000
    df = spark.createDataFrame([("a", bytearray(wav(0.5 * np.sin(2 * np.pi * 1000 * t)))), ("b", bytearray(wav(np.zeros(100)))), ("c", bytearray(b"x"))], "path string, content binary")
    rows = media.sound_chunks(df, "path", "content").collect()
    a = sorted((r for r in rows if r["doc"] == "a"), key=lambda r: r["chunk_index"])
    assert [(r["start_pos"], r["end_pos"]) for r in a] == [(0, 30000), (30000, 31000)] and len(a[0]["mfcc"]) == 13
    assert abs(a[0]["centroid"] - 1000) < 60 and abs(a[0]["loudness"] - 0.35) < 0.02 and abs(a[0]["zero_crossings"] - 0.25) < 0.01 and abs(a[0]["rolloff"] - 1000) < 30
    assert [(r["content"], r["end_pos"]) for r in rows if r["doc"] == "b"] == [(bytearray(b""), 0)] and [r for r in rows if r["doc"] == "c"][0]["error"]


def test_pages(spark):
    assert media.page_chunks_of(["one", " ", "three"]) == [(0, "[Page 1]\none", 0, 1000, None), (1, "[Page 3]\nthree", 2000, 3000, None)]
    df = spark.createDataFrame([("a", bytearray(b"%PDF-"))], "path string, content binary")
    assert media.page_chunks(df, "path", "content").first()["error"]
