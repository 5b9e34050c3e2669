"""Media columns: WAV bytes in, spectral-peak pair fingerprints out.

Samples are framed, freed of each frame's mean and windowed, each frame's
spectrum is taken, and the strongest bin of each band is a peak if it stands out
from its band's mean, as it does in noise too; a constant frame has none.
Each peak is paired with the next few in time; a pair's two bins and time
difference, and the time of its first peak, make one 64-bit code. Frames are
handled in blocks, so memory does not grow with a recording but for its peaks.

Defined results: null text is an empty text, stored as 64 zero samples; equal
bytes give equal results; ids may repeat; a recording shorter than a frame is
padded with silence; further columns of a text table are dropped, those of a
media table pass through.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, through_arrow

RATE, UNIT = 8000, 64
FRAME, HOP, BLOCK = 256, 128, 4096
#: Edges of the bands, in bins; peaks paired with each; largest time difference in frames.
BANDS, FAN, REACH = (1, 8, 20, 48, 129), 3, 63
#: How far a peak exceeds its band's mean; and the least power that isn't rounding.
STANDS_OUT, LEAST_POWER = 1.25, 0.5
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Frame and bin of each peak, by frame, then bin; and the number of frames."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    times, bins = [], []
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        part = x[at * HOP : at * HOP + (m - 1) * HOP + FRAME].astype(np.float32) - 128
        if len(part) < (m - 1) * HOP + FRAME:
            part = np.concatenate((part, np.zeros((m - 1) * HOP + FRAME - len(part), np.float32)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        real = np.clip(len(x) - (np.arange(m) + at) * HOP, 1, FRAME)  # samples of a frame that aren't padding
        mean = (frames.sum(1) / real).astype(np.float32)[:, None]
        power = np.abs(np.fft.rfft((frames - np.where(np.arange(FRAME) < real[:, None], mean, np.float32(0))) * _WINDOW, axis=1))
        top, high = [], []
        for a, b in zip(BANDS[:-1], BANDS[1:], strict=True):
            band = power[:, a:b]
            k = band.argmax(1)
            top.append(k + a)
            best = band[np.arange(m), k]
            high.append((best > STANDS_OUT * band.mean(1)) & (best > LEAST_POWER))
        t, band = np.nonzero(np.stack(high, 1))
        times.append(t + at)
        bins.append(np.stack(top, 1)[t, band])
    return np.concatenate(times), np.concatenate(bins), n


def fingerprint(samples: bytes) -> tuple[np.ndarray, int]:
    """Codes (bin, bin, time difference, time of the first peak) in order of time, and the number of frames."""
    t, f, n = peaks(samples)
    found = []
    for k in range(1, FAN + 1):
        dt = t[k:] - t[:-k]
        near = dt <= REACH
        code = (f[:-k].astype(np.int64) << 54) | (f[k:].astype(np.int64) << 46) | (dt << 40) | t[:-k]
        found.append(np.stack((t[:-k][near], code[near])))
    both = np.concatenate(found, 1)
    return both[1][np.lexsort((both[1], both[0]))], n


def text_media(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident), n_bytes, media: each text's UTF-8 bytes, zero-padded to whole units, as WAV; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t.as_py() or b"" for t in b.column(1).cast(pa.binary())]
            media = [to_wav(x + bytes(-len(x) % UNIT if x else UNIT)) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], [ident, "n_bytes", "media"])

    rows = docs.select(ident, text)
    return stored(through_arrow(rows, run, rows.selectExpr(f"`{ident}`", "0L AS n_bytes", "X'' AS media").schema), "media", compression="zstd")


def features(recordings: DataFrame, media: str = "media") -> DataFrame:
    """``recordings`` with payload (the samples), frames and fingerprint (time-coded pairs)."""
    recordings = recordings.drop("payload", "frames", "fingerprint")
    names = recordings.columns
    at = names.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payload = [from_wav(x.as_py()) for x in b.column(at)]
            found = [fingerprint(x) for x in payload]
            cols = [pa.array(payload, pa.binary()), pa.array([n for _, n in found], pa.int32()), pa.array([c for c, _ in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*names, "payload", "frames", "fingerprint"])

    return through_arrow(recordings, run, recordings.selectExpr("*", "X'' AS payload", "0 AS frames", "cast(array() AS array<bigint>) AS fingerprint").schema)
