"""Media columns: payloads as WAV, read by the wave module; spectral-peak pair fingerprints with their times."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

RATE, FRAME, HOP = 8000, 256, 64
#: Peaks of a frame (the strongest in so many bands) are paired with those of the next FAN frames.
BANDS, FAN, FRAMES_AT_ONCE = 3, 2, 4096


def to_wav(payload: bytes) -> bytes:
    """The payload as 8-bit unsigned mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("8-bit mono expected")
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes) -> np.ndarray:
    """(frames, BANDS): the strongest bin of each band of each frame of the short-time Fourier transform.

    Silence around the samples puts each of them, first and last ones too, into FRAME / HOP frames, at different places of
    the window, whose ends are 0. Magnitudes are rounded, and of equal ones the lower bin counts, so that equal samples
    always give equal peaks. Some thousands of frames at once, whatever the length.
    """
    lead = FRAME - HOP
    x = np.frombuffer(samples, np.uint8)
    x = np.concatenate([np.full(lead, 128, np.uint8), x, np.full(lead + -len(x) % HOP, 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    edges = np.unique(np.geomspace(1, FRAME // 2 + 1, BANDS + 1).astype(int))
    shape, out = np.hanning(FRAME), []
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        power = np.round(np.abs(np.fft.rfft((frames[at : at + FRAMES_AT_ONCE].astype(np.float64) - 128) * shape, axis=1)), 3)
        out.append(np.stack([a + power[:, a:b].argmax(axis=1) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1))
    return np.concatenate(out).astype(np.int64)


def fingerprints(samples: bytes) -> np.ndarray:
    """(n, 2): the time (frame) and the code of each pair of peaks; a code holds both bins and the frames between."""
    peaks = spectral_peaks(samples)
    n, bands = peaks.shape
    codes = np.full((n, FAN, bands, bands), -1, np.int64)
    for gap in range(1, min(FAN, n - 1) + 1):
        codes[: n - gap, gap - 1] = (peaks[: n - gap, :, None] << 16) | (peaks[gap:, None, :] << 4) | gap
    pairs = np.stack([np.repeat(np.arange(n), FAN * bands * bands), codes.ravel()], axis=1)
    return pairs[pairs[:, 1] >= 0]


def payload_of(text: str | None, unit: int = 192) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % unit or unit * (not raw))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrays: bool = True) -> DataFrame:
    """Each row's payload stored as WAV (media), read back, and its fingerprints as time-coded arrays.

    Columns: the id, n_bytes, media binary, payload binary as read back, times array<int>, codes array<int>. Without
    arrays, only digests of them: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature
    (pairs of peaks, the digest of the time-coded array). Null text: empty, one unit of spaces. Each row is worked alone,
    repeated ones alike; ids pass through as they are, other columns are left out. No rows: none.
    """
    wide = "media binary, payload binary, times array<int>, codes array<int>"
    thin = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(texts: Iterator[str | None]) -> dict[str, pa.Array]:
        rows = []
        for text in texts:
            n, payload = payload_of(text)
            media = to_wav(payload)
            back = from_wav(media)
            pairs = fingerprints(back)
            if arrays:
                rows.append((n, media, back, pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32)))
            else:
                digest = hashlib.sha256(pairs.astype("<i8").tobytes()).hexdigest()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(pairs)}:{digest}"))
        names = ["n_bytes", *[x.split()[0] for x in (wide if arrays else thin).split(", ")]]
        return {name: pa.array([row[i] for row in rows]) for i, name in enumerate(names)}

    return map_texts(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), text_col, f"n_bytes long, {wide if arrays else thin}", run, keep=False)
