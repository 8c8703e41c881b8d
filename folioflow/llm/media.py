"""Media columns: text bytes stored as audio, and audio features.

A payload of bytes is stored losslessly as an 8-bit mono WAV blob. Features:
polyphase resampling by a rational factor, overlapped log-mel filterbanks,
hysteresis segmentation on frame energy, and fixed-shape Arrow tensors of
``TENSOR_FRAMES`` x ``MELS`` values with their time spans, from which the query
takes its band means.

Scale: one map to store the blobs, one map to read them back; no shuffle.
Frames are computed in slabs, so a very long payload needs little memory.

Defined results: a null or empty text is a payload of padding bytes alone.
Features depend on the payload alone, so equal texts give equal values. Other
columns than ``doc_id`` and ``text`` are ignored; empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import staged

#: Payloads are padded with this byte to a positive multiple of this size.
PAD, MULTIPLE = b"\xff", 576
#: Stored sample rate; resampling factors; filter taps of each phase.
RATE, UP, DOWN, TAPS = 8000, 3, 4, 12
#: Frames of the resampled signal, and the filterbank.
FRAME, HOP, FFT, MELS = 150, 60, 256, 24
TENSOR_FRAMES, SLAB_FRAMES = 64, 8192
#: Standard deviations above the mean energy that open a segment, and that keep it open.
OPEN_AT, KEEP_AT = 0.5, 0.0
_WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + PAD * (-len(raw) % MULTIPLE or (0 if raw else MULTIPLE))


def to_wav(payload: bytes) -> bytes:
    """8-bit unsigned PCM, mono."""
    return _WAV.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(blob: bytes) -> bytes:
    head = _WAV.unpack_from(blob)
    if head[0] != b"RIFF" or head[2] != b"WAVE" or head[10] != 8 or head[12] != len(blob) - _WAV.size:
        raise ValueError("not an 8-bit WAV blob")
    return blob[_WAV.size :]


@lru_cache(1)
def _phases() -> np.ndarray:
    """Windowed-sinc low-pass split into UP phases of TAPS taps."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cutoff = 0.9 / max(UP, DOWN)
    h = np.sinc(t * cutoff) * np.hamming(n)
    h = h / h.sum() * UP
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP / DOWN; output n is phase n * DOWN % UP at input n * DOWN // UP."""
    phases = _phases()
    padded = np.concatenate((np.zeros(TAPS - 1, np.float32), x))
    seen = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(-(-len(x) * UP // DOWN), np.float32)
    for k in range(UP):
        first = k * DOWN // UP
        n = len(out[k::UP])
        for a in range(0, n, 1 << 16):
            b = min(n, a + (1 << 16))
            out[k + a * UP : k + (b - 1) * UP + 1 : UP] = seen[first + a * DOWN : first + (b - 1) * DOWN + 1 : DOWN] @ phases[k * DOWN % UP]
    return out


@lru_cache(1)
def _filterbank() -> tuple[np.ndarray, np.ndarray]:
    """Analysis window, and triangular mel filters over the power spectrum."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))
    return np.hanning(FRAME).astype(np.float32), bank.T.astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Decibels, frames x MELS; a signal shorter than a frame is padded to one."""
    window, bank = _filterbank()
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for a in range(0, len(frames), SLAB_FRAMES):
        spectrum = np.fft.rfft(frames[a : a + SLAB_FRAMES] * window, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[a : a + SLAB_FRAMES] = 10 * np.log10(power @ bank + 1e-6)
    return out


def segments(mel: np.ndarray) -> np.ndarray:
    """First frame and end of each active stretch: opened at a high energy, kept down to a low one."""
    energy = mel.mean(axis=1)
    mean, spread = float(energy.mean()), float(energy.std())
    event = np.where(energy >= mean + OPEN_AT * spread, 1, np.where(energy < mean + KEEP_AT * spread, -1, 0))
    if not spread:
        event[:] = 1
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    active = np.where(last >= 0, event[last], -1) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], active.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def features(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and segments of a payload."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x))
    return mel, segments(mel)


def tensor_of(mel: np.ndarray) -> pa.FixedShapeTensorArray:
    """Tensors of TENSOR_FRAMES x MELS; the last one is padded with the lowest value."""
    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), mel.min(), np.float32)
    full[: len(mel)] = mel
    return pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, TENSOR_FRAMES, MELS))


def tensor_windows(mel: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """A document's tensors with start_s, end_s and active (share of frames)."""
    step, length = HOP * DOWN / UP / RATE, FRAME * DOWN / UP / RATE
    tensor = tensor_of(mel)
    n = len(tensor)
    inside = np.zeros(len(mel) + 1, np.int64)
    inside[found[:, 0]] += 1
    inside[found[:, 1]] -= 1
    active = np.concatenate(([0], np.cumsum(np.cumsum(inside[:-1]))))
    at = np.arange(n) * TENSOR_FRAMES
    ends = np.minimum(at + TENSOR_FRAMES, len(mel))
    cols = [tensor, pa.array(at * step), pa.array((ends - 1) * step + length), pa.array((active[ends] - active[at]) / (ends - at))]
    return pa.RecordBatch.from_arrays(cols, ["tensor", "start_s", "end_s", "active"])


def store_tensors(media: DataFrame) -> DataFrame:
    """Staged table of doc_id, n_windows and windows: an Arrow stream with a fixed-shape tensor column and time spans."""
    key = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                own = [tensor_windows(*features(from_wav(b.as_py()))) for b in batch.column(1).slice(a, 256)]
                blobs = []
                for windows in own:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, windows.schema) as out:
                        out.write_batch(windows)
                    blobs.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array([w.num_rows for w in own], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n_windows", "windows"])

    return staged(media.select("doc_id", "media").mapInArrow(run, f"doc_id {key}, n_windows long, windows binary"))


def read_tensors(windows: bytes) -> pa.RecordBatch:
    """What ``store_tensors`` wrote of one document."""
    return pa.ipc.open_stream(windows).read_next_batch()


def store_media(docs: DataFrame) -> DataFrame:
    """Staged table of doc_id, n_bytes and media (WAV blobs)."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                texts = batch.column(1).slice(a, 512).to_pylist()
                blobs = pa.array([to_wav(payload_of(t)) for t in texts], pa.binary())
                sizes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 512), sizes, blobs], ["doc_id", "n_bytes", "media"])

    return staged(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_bytes long, media binary"))


def media_digests(media: DataFrame) -> DataFrame:
    """What each stored blob holds, read back: sizes, digests and a feature summary.

    ``feature`` names the frames, segments and active frames, then the mean of
    every mel band in whole decibels.
    """
    key = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob in batch.column(2):
                blob = blob.as_py()
                payload = from_wav(blob)
                mel, found = features(payload)
                frames = tensor_of(mel).to_numpy_ndarray().reshape(-1, MELS)[: len(mel)]
                bands = ",".join(str(int(v)) for v in np.floor(frames.mean(axis=0, dtype=np.float64) + 0.5))
                text = f"frames={len(mel)};segments={len(found)};active={int((found[:, 1] - found[:, 0]).sum())};mel={bands}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), text))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names)

    shape = f"doc_id {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, shape)


def media_tensors(media: DataFrame) -> DataFrame:
    """The tensors as rows: doc_id, window, start_s, end_s, active, tensor.

    ``tensor`` has TENSOR_FRAMES * MELS values, frame by frame. Spark has no
    fixed-size lists, so here it is an array; ``store_tensors`` keeps the
    Arrow type.
    """
    key = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, blob in zip(batch.column(0), batch.column(1), strict=True):
                windows = tensor_windows(*features(from_wav(blob.as_py())))
                n = windows.num_rows
                tensor = windows.column("tensor").storage.cast(pa.list_(pa.float32()))
                cols = [pa.array([k.as_py()] * n, k.type), pa.array(np.arange(n), pa.int32()), *(windows.column(c) for c in ("start_s", "end_s", "active")), tensor]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "window", "start_s", "end_s", "active", "tensor"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {key}, window int, start_s double, end_s double, active double, tensor array<float>")
