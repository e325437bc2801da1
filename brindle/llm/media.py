"""Media columns: audio stored losslessly, read back and described.

Samples are kept as 8-bit PCM in a RIFF/WAVE file in memory.  Reading parses the file
again; features come from what was read: polyphase resampling to half the rate, log-mel
energies of overlapping frames, and active spans by energy with hysteresis.  The general
interface returns segments as rows of fixed shape (``FRAMES`` x ``MELS`` float32) with
their time spans; ``tensor_table`` makes Arrow fixed-shape tensors of collected rows, on the
driver.  Nothing stores tensors yet.

Null and empty inputs have a payload of zeros and so silent features.  Equal bytes give
equal values.  Long inputs are read in blocks, so that memory is bounded by the file
itself.  Repeated rows are treated alike.
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

from ._session import arrow, id_type
from ._text import utf8

RATE = 16_000
FRAME, HOP, FFT, MELS, FRAMES = 200, 80, 256, 24, 98
#: Energy over the quietest tenth, in dB, at which a span begins and below which it ends.
OPEN_DB, CLOSE_DB = 6.0, 3.0
#: Frames worked on at once.
BLOCK = 4096


def pad(data: bytes, unit: int = 64) -> bytes:
    """Zeros up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono samples as a WAVE file; chunks are padded to even length."""
    odd = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + bytes(odd)


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif kind == b"data":
            if at + 8 + size > len(media):
                raise ValueError("the file is cut short")
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@lru_cache(4)
def _taps(up: int, down: int, half: int = 12) -> np.ndarray:
    """Windowed-sinc low-pass of a rational resampler, one row for each of its ``up`` phases."""
    wide = max(up, down)
    n = 2 * half * wide + 1
    t = (np.arange(n) - n // 2) / wide
    h = np.sinc(t) * np.kaiser(n, 6.0)
    h *= up / h.sum()
    h = np.concatenate([h, np.zeros(-len(h) % up)])
    return h.reshape(-1, up).T.copy()


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling by ``up / down``: each output takes the one filter phase that
    lands on it, so nothing is computed between samples or for dropped ones."""
    phases = _taps(up, down)
    n = -(-len(x) * up // down)
    center = (2 * 12 * max(up, down) + 1) // 2
    out = np.zeros(n, np.float32)
    width = phases.shape[1]
    for k in range(min(up, n)):  # outputs k, k + up, ... share one phase
        first = k * down + center
        phase, base = first % up, first // up
        index = np.arange(k, n, up)
        padded = np.concatenate([np.zeros(width, np.float32), x, np.zeros(base + down + width, np.float32)])
        part = np.zeros(len(index), np.float32)
        for j in range(width):
            at = width + base - j
            part += np.float32(phases[phase, j]) * padded[at : at + down * len(index) : down][: len(index)]
        out[index] = part
    return out


@lru_cache(2)
def _mel(rate: int) -> np.ndarray:
    """Triangular filters, even on the mel scale, over the bins of a spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)
    rise = (f - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    fall = (edge[2:, None] - f) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Log-mel rows and energies in dB of overlapping frames, a block at a time."""
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for lo in range(0, len(frames), BLOCK):
        some = frames[lo : lo + BLOCK]
        spectrum = np.fft.rfft(some * _WINDOW, FFT).astype(np.complex64)
        power = spectrum.real**2 + spectrum.imag**2
        energy = 10 * np.log10((some * some).mean(axis=1) + np.float32(1e-10))
        yield np.log(power @ _mel(rate) + np.float32(1e-6)), energy


def spans(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames of active spans: opened at OPEN_DB over the floor, closed below CLOSE_DB."""
    if not len(energy):
        return []
    floor = np.partition(energy, len(energy) // 10)[len(energy) // 10]
    high, low = energy >= floor + OPEN_DB, energy < floor + CLOSE_DB
    # at each frame the last decisive one rules: +1 opens, -1 closes
    mark = np.where(high, 1, np.where(low, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)] > 0, False)
    edge = np.diff(np.concatenate(([0], on.view(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def analyse(payload: bytes, rate: int = RATE) -> tuple[np.ndarray, np.ndarray, int]:
    """Log-mel rows, energies and the rate they are at."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    x, rate = resample(x, 1, 2), rate // 2
    rows, energy = zip(*log_mel(x, rate), strict=True)
    return np.concatenate(rows), np.concatenate(energy), rate


def feature_text(payload: bytes, rate: int = RATE) -> str:
    """Frames, active spans, their share, and the mean of each mel band."""
    rows, energy, _ = analyse(payload, rate)
    found = spans(energy)
    active = sum(b - a for a, b in found)
    return f"frames={len(rows)};spans={len(found)};active={active};mel=" + ",".join(f"{v:.2f}" for v in rows.mean(axis=0, dtype=np.float64) + 0.0)


def segments(docs: DataFrame, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """One row for each FRAMES-frame segment of each binary payload: its number, its time
    span in seconds, active seconds, and FRAMES * MELS log-mel values (the last is padded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                rows, energy, rate = analyse(pad(data or b""))
                on = np.zeros(len(rows), bool)
                for a, b in spans(energy):
                    on[a:b] = True
                for k, lo in enumerate(range(0, len(rows), FRAMES)):
                    part = rows[lo : lo + FRAMES]
                    full = np.full((FRAMES, MELS), np.log(np.float32(1e-6)), np.float32)
                    full[: len(part)] = part
                    span = lo * HOP / rate, ((lo + len(part) - 1) * HOP + FRAME) / rate
                    yield pa.record_batch([batch.column(0).slice(i, 1), pa.array([k], pa.int32()), pa.array([span[0]]), pa.array([span[1]]), pa.array([on[lo : lo + FRAMES].sum() * HOP / rate]), pa.array([full.ravel()], pa.list_(pa.float32()))], names=[id_col, "segment", "start_s", "end_s", "active_s", "log_mel"])

    return arrow(docs.select(id_col, payload_col), run, f"{id_col} {id_type(docs, id_col)}, segment int, start_s double, end_s double, active_s double, log_mel array<float>")


def tensor_table(rows: pa.Table) -> pa.Table:
    """``segments`` rows with log_mel as Arrow fixed-shape tensors."""
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS), dim_names=("frame", "mel"))
    flat = rows["log_mel"].combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    values = pa.FixedSizeListArray.from_arrays(flat.flatten().cast(pa.float32()), FRAMES * MELS)
    return rows.set_column(rows.schema.get_field_index("log_mel"), "log_mel", pa.ExtensionArray.from_storage(kind, values))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text's bytes as audio, read them back and describe them."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in utf8(batch.column(1)):
                media = encode_wav(pad(text or b""))
                payload, rate = decode_wav(media)
                rows.append((len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(payload, rate)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, *names])

    return arrow(docs.select(id_col, text_col), run, f"{id_col} {id_type(docs, id_col)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
