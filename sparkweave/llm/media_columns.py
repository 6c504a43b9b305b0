"""Operator 10: media columns.

A payload is stored losslessly as the samples of an 8-bit mono WAV, read back by the
wave module and turned into short-time Fourier magnitudes. Local peaks of these are
paired with the peaks that follow; each pair's two bins and time gap make one code,
kept with its frame in time order.

Cases: a null text is an empty payload, padded to one block of spaces; equal texts
give equal values; for the transform alone a payload stands in silence, up to a whole
number of frames, so that each byte counts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import map_batches, texts_of

#: A payload is padded to a multiple of BLOCK bytes; frames and hops of the transform.
BLOCK, FRAME, HOP, RATE = 192, 256, 128, 8000
#: A peak is the largest of its bins' neighbourhood and of the frames around; each
#: is paired with at most FAN of the peaks within GAP frames after it.
BINS, AROUND, FAN, GAP = 16, 2, 3, 31
#: Frames transformed at a time, so that a long payload takes bounded memory.
CHUNK = 4096
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_frames long, code_frames array<int>, codes array<int>"
)


def store(payload: bytes) -> bytes:
    """The payload as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are needed")
        return w.readframes(w.getnframes())


def band_peaks(samples: bytes) -> np.ndarray:
    """Magnitude and bin of the strongest line of each band in each frame: (frames, bands, 2)."""
    signal = np.frombuffer(samples, np.uint8)
    silence = lambda n: np.full(n, 128, np.uint8)
    # The window is 0 at a frame's ends, so half a frame of silence stands before and after.
    signal = np.concatenate([silence(HOP), signal, silence(HOP + -len(signal) % HOP)])
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    window, out = np.hanning(FRAME).astype(np.float32), []
    for at in range(0, len(frames), CHUNK):
        part = (frames[at : at + CHUNK].astype(np.float32) - 128) * window
        lines = np.abs(np.fft.rfft(part, axis=1))[:, 1:].reshape(len(part), -1, BINS)  # without the constant line
        best = lines.argmax(axis=2)
        out.append(np.stack([np.take_along_axis(lines, best[:, :, None], 2)[:, :, 0].round(3), best + 1 + BINS * np.arange(lines.shape[1])], axis=2))
    return np.concatenate(out)


def fingerprint(samples: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of frames; the codes of all peak pairs with the frames of their first peaks."""
    bands = band_peaks(samples)
    height = bands[:, :, 0]
    n = len(height)
    top = np.ones(height.shape, bool)
    for d in range(1, min(AROUND, n - 1) + 1):  # ties go to the earlier frame
        top[d:] &= height[d:] > height[:-d]
        top[:-d] &= height[:-d] >= height[d:]
    top &= height > 0
    frame, band = np.nonzero(top)
    line = bands[frame, band, 1].astype(np.int64)
    at, codes = [], []
    for step in range(1, FAN + 1):
        gap = frame[step:] - frame[:-step]
        near = (gap >= 0) & (gap <= GAP)
        at.append(frame[:-step][near])
        codes.append((line[:-step][near] << 13) | (line[step:][near] << 5) | gap[near])
    at, codes = np.concatenate(at), np.concatenate(codes)
    order = np.lexsort((codes, at))
    return n, at[order].astype(np.int32), codes[order].astype(np.int32)


def media_columns(docs: DataFrame) -> DataFrame:
    """One row for each document: sizes and digests of the stored form, and its time-coded fingerprint.

    ``feature`` is the SHA-256 of the two arrays as little-endian 32-bit numbers.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in SCHEMA.replace(",", " ").split()[::2]}
            out["doc_id"] = batch.column("doc_id")
            for text in texts_of(batch):
                raw = text.encode()
                media = store(raw + b" " * (BLOCK * max(1, -(-len(raw) // BLOCK)) - len(raw)))
                payload = read_back(media)
                frames, at, codes = fingerprint(payload)
                row = {
                    "n_bytes": len(raw),
                    "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-16:]),
                    "media_bytes": len(media),
                    "media_sha256": hashlib.sha256(media).hexdigest(),
                    "feature": hashlib.sha256(at.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest(),
                    "n_frames": frames,
                    "code_frames": at,
                    "codes": codes,
                }
                for name, value in row.items():
                    out[name].append(value)
            return out

        return work

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)
