"""Media columns: bytes stored as WAV samples, read back, and fingerprinted by pairs of spectral peaks.

A text's UTF-8 bytes, padded with spaces to a positive multiple of ``block``, are the 8-bit mono samples of a WAV file
written and read by the wave module. From what is read back, with silence before and after it so that frames cover all
samples, overlapping frames go through a short-time Fourier transform (Hann window); the ``top`` strongest local maxima of
each frame are peaks (of equal ones, any), and each peak is paired with all peaks of the target zone behind it, the
following frames up to ``reach`` away. A pair's code is first bin, second bin and distance; it is stored with its time as
one long, ``code << 32 | frame``, in an array, ordered by time and code.

One pass without a shuffle; frames are transformed in blocks, so memory is bounded by the text, however long. Null counts
as empty (``block`` spaces). An empty table has no rows. Equal texts have equal media and features; repeated rows have one
row each. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import lists, utf8

FIELDS = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, landmarks array<bigint>"


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def padded(raw: bytes, block: int = 192) -> bytes:
    return raw + b" " * (block * max(1, -(-len(raw) // block)) - len(raw))


def peaks(samples: bytes, frame: int = 256, hop: int = 192, top: int = 4, many: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of each peak: local maxima over the bins, at most top in a frame, in order."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    # Silence around them: every sample, the first and the last too, is in a frame whose window isn't zero there.
    lead = frame - hop
    x = np.pad(x, (lead, frame + hop * (-(-(lead + len(x)) // hop) - 1) - lead - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    window = np.hanning(frame).astype(np.float32)
    times, bins = [], []
    for i in range(0, len(frames), many):
        power = np.abs(np.fft.rfft(frames[i : i + many] * window, axis=1)).astype(np.float32)[:, 1:]
        inner = power[:, 1:-1]
        high = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        best = np.sort(np.argpartition(-high, top - 1, axis=1)[:, :top], axis=1)
        t, k = np.nonzero(np.take_along_axis(high, best, 1) > 0)
        times.append(t + i)
        bins.append(best[t, k] + 2)
    return np.concatenate(times), np.concatenate(bins)


def landmarks(samples: bytes, frame: int = 256, hop: int = 192, top: int = 4, reach: int = 3) -> np.ndarray:
    """Pair codes with their times, ordered by time and code."""
    t, b = peaks(samples, frame, hop, top)
    out = []
    for step in range(1, top * (reach + 1)):
        dt = t[step:] - t[:-step]
        ok = (dt > 0) & (dt <= reach)
        code = (b[:-step][ok] << 20) | (b[step:][ok] << 8) | dt[ok]
        out.append((code.astype(np.int64) << 32) | t[:-step][ok])
    flat = np.concatenate(out) if out else np.zeros(0, np.int64)
    return flat[np.lexsort((flat >> 32, flat & 0xFFFFFFFF))]


def media(docs: DataFrame, block: int = 192, tail: int = 16) -> DataFrame:
    """doc_id with its media digests, a digest of its landmarks as ``feature``, and the landmarks themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                data, offsets = utf8(part.column(1))
                raw = data.tobytes()
                rows, marks = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    wav = to_wav(padded(raw[a:b], block))
                    back = from_wav(wav)
                    found = landmarks(back)
                    marks.append(found)
                    feature = f"stft256:{len(found)}:{hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest()}"
                    rows.append((b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-tail:]), len(wav), hashlib.sha256(wav).hexdigest(), feature))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                ends = np.cumsum([0, *map(len, marks)])
                names = ["doc_id", *(c.split()[0] for c in FIELDS.split(", "))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), lists(np.concatenate(marks), ends, pa.int64())], names=names)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, f"doc_id bigint, {FIELDS}")
