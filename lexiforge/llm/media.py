"""Operator 9: media columns: WAV samples, their short-time spectra and peak-pair fingerprints.

A payload is stored as the samples of a mono 8-bit WAV file by the wave module and read
back from the stored bytes. Frames of FRAME samples at steps of HOP are windowed and
transformed; in each of a few bands the strongest bin is a peak if it stands above
the frame's mean. A peak is paired with those of the next REACH frames in the same or
the next band: code = first bin, second bin, distance in frames, at the first peak's frame.

Defined cases: null text is empty and gives one block of blanks; long payloads are
transformed in runs of frames, with the same result; repeated rows repeat; equal
payloads give equal values; an empty table gives an empty result; other columns are kept,
but for those named like an added one in any case, which it replaces.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import with_batches

UNIT = 192
RATE = 8000
FRAME, HOP = 512, 256
BANDS = (2, 16, 40, 96, 257)
REACH = 3
RUN = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload of a text and its length before the blanks."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % UNIT if data else UNIT), len(data)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Strongest bin of each band in each frame, -1 where none stands out: (frames, bands)."""
    x = np.frombuffer(samples, np.uint8)
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, (frames - 1) * HOP + FRAME - len(x)), constant_values=128)
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((frames, len(BANDS) - 1), np.int32)
    for at in range(0, frames, RUN):
        part = (view[at : at + RUN].astype(np.float32) - 128.0) * _WINDOW
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32)
        floor = 2.0 * power[:, BANDS[0] :].mean(axis=1)
        for b, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            best = power[:, low:high].argmax(axis=1)
            strong = power[np.arange(len(power)), low + best] > floor
            out[at : at + RUN, b] = np.where(strong, low + best, -1)
    return out


def peak_pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of all pairs, in order of time and code."""
    times, codes = [], []
    for step in range(1, REACH + 1):
        a, b = found[:-step], found[step:]
        for shift in (0, 1):
            one, two = (a, b) if not shift else (a[:, :-1], b[:, 1:])
            at = np.nonzero((one >= 0) & (two >= 0))
            times.append(at[0])
            codes.append((one[at].astype(np.int64) << 20) | (two[at].astype(np.int64) << 8) | step)
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order]


def describe(text: str | None) -> tuple:
    """n_bytes, media, payload read back, times and codes of a text."""
    payload, n = padded(text)
    media = to_wav(payload)
    back = from_wav(media)
    return (n, media, back, *peak_pairs(peaks(back)))


#: Columns that `media_columns` can add, with their kinds.
COLUMNS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary(), "fp_time": pa.list_(pa.int32()), "fp_code": pa.list_(pa.int64())}
_SPARK = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "media": "binary", "fp_time": "array<int>", "fp_code": "array<long>"}


def media_columns(docs: DataFrame, keep: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all if None) and the named media columns (all if None)."""
    wanted = list(COLUMNS) if columns is None else columns

    def values(text: str | None) -> dict:
        n, media, back, time, code = describe(text)
        out = {"n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
        digest = hashlib.sha256(time.astype("<i4").tobytes() + code.astype("<i8").tobytes()).hexdigest()[:32]
        return out | {"feature": f"{len(code)}:{digest}", "media": media, "fp_time": time, "fp_code": code}

    def make(texts: pa.Array) -> list[pa.Array]:
        made = []
        for text in texts.to_pylist():
            full = values(text)
            made.append({c: full[c] for c in wanted})
        return [pa.array([m[c] for m in made], COLUMNS[c]) for c in wanted]

    return with_batches(docs, docs.columns if keep is None else keep, [F.col("text")], ", ".join(f"{c} {_SPARK[c]}" for c in wanted), make)


def op9_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_columns(docs, ["doc_id"], ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
