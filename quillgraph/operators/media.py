"""Chunkers of images and sound, and of PDF pages where a reader for them is installed; one file in, its chunks out, in Arrow batches.

Images are read from PNG (eight bits, not interlaced) and PNM files by numpy, and from other formats if Pillow is installed;
sound from WAV files (PCM).  PDF needs ``fitz`` or ``pypdf``, video ``cv2``; without them their files come back with an error.

Defined results: a file that cannot be read gives one row with ``error`` and no content; a null content likewise.
"""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LARGEST, SEGMENT_SECONDS, LEAST_SECONDS, PAGE = 2048, 30.0, 0.1, 1000
N_FFT, HOP, MELS, MFCC, ROLLOFF = 2048, 512, 128, 13, 0.85


# --- images

def _unfiltered(raw: bytes, height: int, stride: int, bpp: int) -> np.ndarray:
    """The bytes of a PNG's rows without their filters."""
    out, before, at = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8), 0
    for y in range(height):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1).copy()
        at += stride + 1
        if kind == 2:
            line = line + before
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)
        elif kind in (3, 4):
            for i in range(stride):
                a, b, c = int(line[i - bpp]) if i >= bpp else 0, int(before[i]), int(before[i - bpp]) if i >= bpp else 0
                near = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v: abs(a + b - c - v))  # noqa: B023
                line[i] = (int(line[i]) + near) & 255
        out[y], before = line, line
    return out


def _png(data: bytes) -> np.ndarray:
    at, body, palette = 8, b"", None
    width = height = depth = color = interlaced = 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += n + 12
    if depth != 8 or interlaced:
        raise ValueError("only PNG of eight bits that is not interlaced")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    x = _unfiltered(zlib.decompress(body), height, width * channels, channels).reshape(height, width, channels)
    if color == 3:
        return palette[x[:, :, 0]]
    return x[:, :, : 1 if channels < 3 else 3]


def _pnm(data: bytes) -> np.ndarray:
    head = data.split(None, 4)
    width, height = int(head[1]), int(head[2])
    channels = 3 if head[0] == b"P6" else 1
    return np.frombuffer(data, np.uint8, width * height * channels, len(data) - width * height * channels).reshape(height, width, channels)


def pixels(data: bytes) -> np.ndarray:
    """(height, width, 1 or 3) of an image."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] in (b"P5", b"P6"):
        return _pnm(data)
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("this image format needs Pillow") from None
    image = Image.open(io.BytesIO(data))
    x = np.asarray(image if image.mode in ("RGB", "L") else image.convert("RGB"))
    return x if x.ndim == 3 else x[:, :, None]


def shrunk(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size, each new pixel the mean of those it covers (at least one)."""
    out = x.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        size = out.shape[axis]
        edges = np.minimum(np.arange(n) * size // n, size - 1)
        ends = np.maximum(np.append(edges[1:], size), edges + 1)
        total = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
        shape = [1] * out.ndim
        shape[axis] = n
        out = (total.take(ends, axis) - total.take(edges, axis)) / (ends - edges).reshape(shape)
    return out


def average_hash(x: np.ndarray, size: int = 8) -> str:
    """Sixteen hex signs: which of 8 by 8 places are brighter than the mean."""
    gray = x[:, :, 0] if x.shape[2] == 1 else x @ np.array([0.299, 0.587, 0.114])
    small = np.floor(shrunk(gray, size, size) + 0.5)
    bits = "".join("1" if p > small.mean() else "0" for p in small.ravel())
    return f"{int(bits, 2):0{size * size // 4}x}"


def histogram(x: np.ndarray, bins: int = 8) -> list[float]:
    """Shares of brightness: the first bins of a grey image, every 32nd of each colour of another, the colours side by side."""
    counts = [np.bincount(x[:, :, c].ravel(), minlength=256) / max(x[:, :, c].size, 1) for c in range(x.shape[2])]
    if len(counts) == 1:
        return counts[0][:bins].tolist()
    return [float(h[i]) for i in range(0, 256, 256 // bins) for h in counts]


def png_bytes(x: np.ndarray) -> bytes:
    """The image as a PNG file."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((len(x), 1), np.uint8), np.ascontiguousarray(x, np.uint8).reshape(len(x), -1)], 1)
    head = struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0 if x.shape[2] == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


_IMAGE = "chunk_index bigint, content binary, start_pos bigint, end_pos bigint, width int, height int, perceptual_hash string, histogram array<double>, error string"


def _image_chunks(tile: int | None) -> Callable[[bytes], list[tuple]]:
    def chunks(data: bytes) -> list[tuple]:
        x = pixels(data)
        ratio = min(LARGEST / x.shape[0], LARGEST / x.shape[1], 1.0)
        if ratio < 1:
            x = np.floor(shrunk(x, int(x.shape[0] * ratio), int(x.shape[1] * ratio)) + 0.5).astype(np.uint8)
        if tile is None:
            whole = png_bytes(x)
            return [(0, whole, 0, len(whole), x.shape[1], x.shape[0], average_hash(x), histogram(x), None)]
        width, out = x.shape[1], []
        for top in range(0, x.shape[0], tile):
            for left in range(0, width, tile):
                t = x[top : top + tile, left : left + tile]
                out.append((len(out), png_bytes(t), left + top * width, left + tile + (top + tile) * width, t.shape[1], t.shape[0], average_hash(t), histogram(t), None))
        return out

    return chunks


def image_chunks(files: DataFrame, path_col: str, content_col: str, tile: int | None = None) -> DataFrame:
    """Each image whole, or in tiles of ``tile`` pixels a side; images larger than LARGEST are shrunk first."""
    return _chunked(files, path_col, content_col, _image_chunks(tile), _IMAGE)


# --- sound

def _samples(data: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(data)) as w:
        raw, size, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    kinds = {1: (np.uint8, 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}
    kind, zero, scale = kinds[size]
    y = (np.frombuffer(raw, kind).astype(np.float32) - zero) / scale
    return y.reshape(-1, channels).mean(1), rate


def _mel_filters(rate: int) -> np.ndarray:
    """Triangles over the spectrum, evenly spaced in mel and of even area."""
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / (np.log(6.4) / 27))
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    edges = to_hz(np.linspace(0.0, float(to_mel(np.array(rate / 2))), MELS + 2))
    f = np.fft.rfftfreq(N_FFT, 1 / rate)
    rise = (f - edges[:-2, None]) / np.maximum(np.diff(edges)[:-1, None], 1e-9)
    fall = (edges[2:, None] - f) / np.maximum(np.diff(edges)[1:, None], 1e-9)
    return np.maximum(0, np.minimum(rise, fall)) * (2 / np.maximum(edges[2:] - edges[:-2], 1e-9))[:, None]


def sound_features(y: np.ndarray, rate: int) -> tuple[list[float], dict[str, float]]:
    """(mean mel-frequency cepstrum, means of centroid, bandwidth, rolloff, zero crossings and loudness) of one segment."""
    padded = np.pad(y, N_FFT // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, N_FFT)[::HOP]
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(N_FFT + 1)[:-1], axis=1))
    f, total = np.fft.rfftfreq(N_FFT, 1 / rate), np.maximum(spectrum.sum(1), 1e-12)
    db = 10 * np.log10(np.maximum((spectrum**2) @ _mel_filters(rate).T, 1e-10))
    db = np.maximum(db, db.max() - 80)
    k = np.arange(MELS)
    basis = np.cos(np.pi * np.arange(MFCC)[:, None] * (2 * k + 1) / (2 * MELS)) * np.sqrt(2 / MELS)
    basis[0] /= np.sqrt(2)
    centroid = spectrum @ f / total
    bandwidth = np.sqrt((spectrum * (f - centroid[:, None]) ** 2).sum(1) / total)
    upto = np.cumsum(spectrum, 1)
    rolloff = f[np.argmax(upto >= ROLLOFF * upto[:, -1:], 1)]
    crossings = (np.diff(np.signbit(frames), axis=1)).mean(1)
    means = {"centroid": centroid, "bandwidth": bandwidth, "rolloff": rolloff, "zero_crossings": crossings, "loudness": np.sqrt((frames**2).mean(1))}
    return (db @ basis.T).mean(0).tolist(), {n: float(v.mean()) for n, v in means.items()}


_SOUND = "chunk_index bigint, content binary, start_pos bigint, end_pos bigint, sample_rate int, mfcc array<double>, centroid double, bandwidth double, rolloff double, zero_crossings double, loudness double, error string"


def _sound_chunks(data: bytes) -> list[tuple]:
    y, rate = _samples(data)
    step, out = int(SEGMENT_SECONDS * rate), []
    for s in range(0, len(y), step):
        part = y[s : s + step]
        if len(part) >= rate * LEAST_SECONDS:
            mfcc, means = sound_features(part, rate)
            out.append((len(out), part.astype(np.float32).tobytes(), int(s / rate * 1000), int((s + len(part)) / rate * 1000), rate, mfcc, *means.values(), None))
    return out or [(0, b"", 0, 0, rate, None, None, None, None, None, None, None)]


def sound_chunks(files: DataFrame, path_col: str, content_col: str) -> DataFrame:
    """Segments of SEGMENT_SECONDS, shorter rests than LEAST_SECONDS left out; positions are milliseconds, sound without a segment gives an empty one."""
    return _chunked(files, path_col, content_col, _sound_chunks, _SOUND)


# --- pages and pictures in motion

def _pages(data: bytes) -> list[str]:
    try:
        import fitz

        with fitz.open(stream=data, filetype="pdf") as doc:
            return [page.get_text() for page in doc]
    except ImportError:
        pass
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("PDF needs fitz or pypdf") from None
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def page_chunks_of(pages: list[str]) -> list[tuple]:
    """(chunk_index, content, start_pos, end_pos, error) of the pages that have text; a page counts PAGE positions."""
    full = [(i, t) for i, t in enumerate(pages) if t.strip()]
    return [(n, f"[Page {i + 1}]\n{t}", i * PAGE, (i + 1) * PAGE, None) for n, (i, t) in enumerate(full)]


def page_chunks(files: DataFrame, path_col: str, content_col: str) -> DataFrame:
    """A chunk a page of each PDF file."""
    return _chunked(files, path_col, content_col, lambda data: page_chunks_of(_pages(data)), "chunk_index bigint, content string, start_pos bigint, end_pos bigint, error string")


def _chunked(files: DataFrame, path_col: str, content_col: str, chunks_of: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    columns = [c.split(" ", 1) for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b[1]):  # one file at a time: its chunks are as large as it
                try:
                    rows = chunks_of(data.as_py() or b"")
                except Exception as e:  # noqa: BLE001 - files come as they are
                    rows = [(0, *[None] * (len(columns) - 2), str(e) or type(e).__name__)]
                cols = zip(*rows, strict=True) if rows else [()] * len(columns)
                yield pa.RecordBatch.from_arrays([b[0].take(pa.array([i] * len(rows), pa.int64())), *(pa.array(v, kinds[k]) for v, (_, k) in zip(cols, columns, strict=True))], ["doc", *(n for n, _ in columns)])

    return files.select(path_col, content_col).mapInArrow(work, f"doc {dict(files.dtypes)[path_col]}, {schema}")
