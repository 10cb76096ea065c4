"""Media columns: WAV through the wave module, short-time Fourier transforms and spectral-peak fingerprints.

Bytes are stored as 8-bit mono samples of a WAV file and read back without loss. Frames of 384 samples every 192 are
transformed; in each of four frequency bands a frame's strongest bin is a peak if it is also at least as strong as in
the frames beside it and over the frame's mean. Each peak is paired with the next peaks of later frames (up to ``fan`` of them, within
``reach`` frames). A landmark packs (bin, bin, frame distance) and stands in an array ordered by time, next to the
array of times, so equal recordings have equal arrays and an excerpt has the same landmarks at shifted times.

Payload: the text's UTF-8 bytes, followed by byte 32 up to a positive multiple of 192.

Cases: null and empty texts give a payload of 192 spaces; silence has no peaks and empty arrays. Long recordings are
transformed in blocks of frames, with bounded memory. Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, FRAME, HOP, RATE = 192, 384, 192, 8000
BANDS = ((1, 12), (12, 40), (40, 96), (96, 193))
RESULT = "doc_id long, n_bytes long, media binary, times array<int>, landmarks array<int>"
HEADER = 44  # bytes of a WAV file before its samples
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks, ordered by time and then by bin."""
    x = np.frombuffer(samples, dtype=np.uint8)
    frames = max(1, (len(x) - FRAME + HOP - 1) // HOP + 1) if len(x) > FRAME else 1
    top = np.zeros((frames, len(BANDS)), dtype=np.int64)
    height = np.zeros((frames, len(BANDS)), dtype=np.float32)
    level = np.zeros(frames, dtype=np.float32)
    for at in range(0, frames, block):
        n = min(block, frames - at)
        part = x[at * HOP : (at + n - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (n - 1) * HOP + FRAME - len(part)), mode="edge")
        view = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        size = np.abs(np.fft.rfft((view - view.mean(axis=1, keepdims=True)) * _WINDOW, axis=1)).astype(np.float32)
        level[at : at + n] = size.mean(axis=1)
        for b, (lo, hi) in enumerate(BANDS):
            best = size[:, lo:hi].argmax(axis=1)
            top[at : at + n, b] = best + lo
            height[at : at + n, b] = size[np.arange(n), best + lo]
    beside = np.zeros_like(height)
    beside[1:] = height[:-1]
    beside[:-1] = np.maximum(beside[:-1], height[1:])
    keep = (height >= beside) & (height > level[:, None]) & (height > 1)
    t, b = np.nonzero(keep)
    return t, top[t, b]


def landmarks(samples: bytes, fan: int = 4, reach: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Times and packed peak pairs, in order of time."""
    t, f = peaks(samples)
    times, codes = [], []
    later = np.searchsorted(t, t, side="right")  # the first peak of a later frame
    for k in range(fan):
        i = np.flatnonzero(later + k < len(t))
        j = later[i] + k
        gap = t[j] - t[i]
        i, j, gap = (v[gap <= reach] for v in (i, j, gap))
        times.append(t[i])
        codes.append(f[i] << 18 | f[j] << 8 | gap)
    at, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, at))
    return at[order].astype(np.int32), code[order].astype(np.int32)


def media_columns(docs: DataFrame, most: int = 8_000_000) -> DataFrame:
    """The WAV file, the text's bytes and the landmark arrays for every row of docs(doc_id, text, ...). Batches have about most bytes."""

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RESULT.split(", ")]
        for batch in it:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                payload, n = payload_of(text)
                media = to_wav(payload)
                at, code = landmarks(from_wav(media))
                rows.append((doc_id, n, media, at, code))
                held += len(media)
                if held >= most:
                    yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(build, RESULT)


def digest(media: DataFrame) -> DataFrame:
    """Sizes and hashes of the file and its samples, the landmark arrays as one string (how many landmarks, and the hash of both arrays), and
    the file and the arrays themselves."""
    arrays = F.concat_ws("|", F.array_join("times", ","), F.array_join("landmarks", ","))
    feature = F.concat_ws(":", F.size("landmarks").cast("string"), F.sha2(arrays, 256))
    file, size = F.col("media"), F.octet_length("media")
    payload = F.substring(file, HEADER + 1, 2**31 - 1)
    return media.select(
        "doc_id",
        "n_bytes",
        (size - HEADER).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(file, -16, 16)).alias("tail_crc32"),
        size.cast("long").alias("media_bytes"),
        F.sha2(file, 256).alias("media_sha256"),
        feature.alias("feature"),
        "media",
        "times",
        "landmarks",
    )
