"""Audio features of media columns (operator 4).

Bytes are stored as mono 8-bit samples in RIFF/WAVE files, a column of a table in the shared folder, and read back.
Features: a polyphase resampler (Hann-windowed sinc, split in its phases), overlapped Hann frames, log-mel filterbanks,
and energy segmentation with hysteresis: a segment starts above the upper threshold and ends below the lower one.
Patches of the log-mel matrix have a fixed shape; they are stored with their time spans and segments as Arrow
fixed-shape tensors in the shared folder, and the digest is computed from what is read back of them.

Every text is computed alone, in blocks over which filter and frames go on, so equal texts give equal values, the
blocks' size changes nothing and the arithmetic's memory is bounded for any length. Defined cases: null text counts as
empty; empty text is padded like any other, to 192 spaces; repeated rows give repeated results; a null id stays null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drop_written, scratch, small_batches, table, written

PAD, RATE, UP, DOWN, FRAME, HOP, MELS, PATCH = 192, 16_000, 1, 2, 256, 128, 32, 64
BLOCK = 1 << 20  # samples in a block; a multiple of DOWN * HOP
STEP_S = HOP * DOWN / (RATE * UP)  # seconds from frame to frame
STEPS, FLOOR = 4, round(4 * float(np.log(1e-6)))  # stored values a unit of the logarithm, and that of silence


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // PAD)) * PAD, b" ")


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of mono 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def from_wave(media: bytes) -> bytes:
    """The samples of a RIFF/WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at = 12
    while at < len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@functools.cache
def phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """The low-pass filter's taps by phase, a row for each of ``up`` phases."""
    cut, n = 1 / max(up, down), 2 * half * max(up, down) // 2
    t = np.arange(-n, n)
    taps = np.sinc(t * cut) * cut * np.hanning(2 * n + 2)[1:-1]
    taps = taps * (up / taps.sum())
    return np.ascontiguousarray(taps.reshape(-1, up).T.astype(np.float32))


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, before: np.ndarray | None = None) -> np.ndarray:
    """``x`` at ``up / down`` times its rate: each output uses the taps of its own phase only.

    ``before``: the samples ahead of ``x``, a filter's length less one; silence by default.
    """
    h = phases(up, down)
    taps = h.shape[1]
    x = np.concatenate([np.zeros(taps - 1, np.float32) if before is None else before, x])
    n = -(-(len(x) - taps + 1) * up // down)
    y = np.zeros(n, np.float32)
    for first in range(up):  # outputs first, first + up, ... share a phase
        phase, base = first * down % up, first * down // up
        count = len(range(first, n, up))
        if count:
            acc = np.zeros(count, np.float32)
            for k in range(taps):
                part = x[base + taps - 1 - k :: down][:count]
                acc[: len(part)] += h[phase, k] * part
            y[first::up] = acc
    return y


@functools.cache
def mel_bank(mels: int = MELS, frame: int = FRAME, rate: int = RATE * UP // DOWN) -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


@functools.cache
def hann(n: int = FRAME) -> np.ndarray:
    return np.hanning(n + 1)[:-1].astype(np.float32)


def log_mel(samples: bytes, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel matrix (frames, mels) and each frame's energy in dB; the filter and the frames go on over blocks."""
    mel, energy, carry, before = [], [], np.zeros(0, np.float32), np.zeros(phases(UP, DOWN).shape[1] - 1, np.float32)
    for s in range(0, len(samples), block):
        x = (np.frombuffer(samples[s : s + block], np.uint8).astype(np.float32) - 128) / 128
        carry = np.concatenate([carry, resample(x, before=before)])
        before = np.concatenate([before, x])[-len(before) :]
        last = s + block >= len(samples)
        if last and len(carry) < FRAME and not mel:
            carry = np.pad(carry, (0, FRAME - len(carry)))
        n = max(0, 1 + (len(carry) - FRAME) // HOP)
        if n:
            frames = np.lib.stride_tricks.sliding_window_view(carry, FRAME)[::HOP][:n]
            power = np.abs(np.fft.rfft(frames * hann(), axis=1)).astype(np.float32) ** 2
            mel.append(np.log(power @ mel_bank() + 1e-6))
            energy.append(10 * np.log10((frames * frames).mean(1) + 1e-10))
        carry = carry[n * HOP :]
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray, up: float = 1.0, down: float = -1.0) -> list[tuple[float, float]]:
    """Time spans (s) that start above the mean plus ``up`` dB and last until below the mean plus ``down`` dB."""
    mean = float(energy.mean())
    mark = np.where(energy > mean + up, 1, np.where(energy < mean + down, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], np.where(at >= 0, mark[at], -1) > 0, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return [(float(a * STEP_S), float(b * STEP_S)) for a, b in zip(edges[::2], edges[1::2])]


def patches(mel: np.ndarray, patch: int = PATCH) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-shape patches (n, patch, mels) in quarter steps of the logarithm, the last padded with the floor, and
    the frames that each covers, from and to."""
    n = -(-len(mel) // patch)
    out = np.full((n * patch, mel.shape[1]), FLOOR, np.int8)
    out[: len(mel)] = np.clip(np.rint(mel * STEPS), -128, 127)
    starts = np.arange(n) * patch
    return out.reshape(n, patch, mel.shape[1]), np.stack([starts, np.minimum(starts + patch, len(mel))], 1)


def feature(cube: np.ndarray, frames: int, spans: list[tuple[float, float]]) -> str:
    """A digest of stored features: frames, segments and their length, mean of four mel bands, CRC-32 of the matrix."""
    q = cube.reshape(-1, cube.shape[-1])[:frames]
    bands = q.reshape(frames, 4, -1).mean((0, 2)) / STEPS
    return f"frames={frames};segments={len(spans)};active={sum(b - a for a, b in spans):.3f};bands={','.join(f'{x:.2f}' for x in bands)};crc={zlib.crc32(q.tobytes()):08x}"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text as a WAVE file, written to the shared folder and read from it."""

    small_batches(docs.sparkSession)
    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 500):
                raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(1)[s : s + 500]]
                media = pa.array([to_wave(padded(x)) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0)[s : s + 500], pa.array([len(x) for x in raw], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return written(docs.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


def _disk(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


class TensorFile:
    """An Arrow file of ``ROWS`` patches a batch: ``doc_id, start_s, end_s, segments`` and the fixed-shape ``mel``.

    ``segments`` holds starts and ends of the energy segments that start within the patch.
    """

    ROWS = 1024
    KIND = pa.fixed_shape_tensor(pa.int8(), (PATCH, MELS))
    SCHEMA = pa.schema([("doc_id", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("segments", pa.list_(pa.float64())), ("mel", KIND)])

    def __init__(self, disk, path: str):
        self.sink = disk.open_output_stream(path, compression=None)
        self.out = pa.ipc.new_file(self.sink, self.SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.rows: list[list] = [[] for _ in self.SCHEMA]
        self.n = 0

    def add(self, doc, cube: np.ndarray, at: np.ndarray, spans: list[tuple[float, float]]) -> None:
        own: list[list[float]] = [[] for _ in cube]
        for a, b in spans:
            own[int(round(a / STEP_S)) // PATCH] += [a, b]
        for mel, (a, b), seg in zip(cube, at.tolist(), own):
            for col, x in zip(self.rows, (doc, a * STEP_S, b * STEP_S, seg, mel)):
                col.append(x)
            self.n += 1
            if len(self.rows[0]) == self.ROWS:
                self.flush()

    def flush(self) -> None:
        if self.rows[0]:
            flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([x.reshape(-1) for x in self.rows[4]])), PATCH * MELS)
            cols = [pa.array(x, f.type) for x, f in zip(self.rows[:4], self.SCHEMA)]
            self.out.write_batch(pa.RecordBatch.from_arrays([*cols, pa.ExtensionArray.from_storage(self.KIND, flat)], schema=self.SCHEMA))
            self.rows = [[] for _ in self.SCHEMA]

    def close(self) -> None:
        self.flush()
        self.out.close()
        self.sink.close()


INDEX = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, file string, first long, patches long"


def store_tensors(media: DataFrame, folder: str) -> DataFrame:
    """Read stored WAVE files, compute their features and write them as tensor files in ``folder``.

    Gives each file's digests and the place of its patches. A repeated task leaves a tensor file that no row names.
    """

    def run(batches):
        import uuid

        disk, root = _disk(folder)
        disk.create_dir(root, recursive=True)
        name, file = f"{uuid.uuid4().hex}.arrow", None
        for b in batches:
            file = file or TensorFile(disk, f"{root}/{name}")
            rows = []
            for doc, size, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                media = blob.as_buffer().to_pybytes()
                back = from_wave(media)
                mel, energy = log_mel(back)
                first = file.n
                file.add(doc, *patches(mel), segments(energy))
                rows.append((doc, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), name, first, file.n - first))
            cols = list(zip(*rows)) or [[]] * 10
            text = pa.string()
            kinds = [pa.int64(), pa.int64(), pa.int64(), text, pa.int64(), pa.int64(), text, text, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], [x.split()[0] for x in INDEX.split(", ")])
        if file:
            file.close()

    return written(media.mapInArrow(run, INDEX), "tensor-index")


def read_features(index: DataFrame, folder: str) -> DataFrame:
    """Each row's digest of the features, from its patches in the tensor files."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def run(batches):
        disk, root = _disk(folder)
        name, file, held = None, None, (-1, None)
        for b in batches:
            out = []
            for f, first, n in zip(*(b.column(c).to_pylist() for c in ("file", "first", "patches"))):
                if f != name:
                    name, file, held = f, pa.ipc.open_file(disk.open_input_file(f"{root}/{f}")), (-1, None)
                cube, spans, frames, at = [], [], 0, first
                while at < first + n:
                    k, r = divmod(at, TensorFile.ROWS)
                    if held[0] != k:
                        held = (k, file.get_batch(k))
                    part = held[1].slice(r, min(TensorFile.ROWS - r, first + n - at))
                    cube.append(part.column("mel").to_numpy_ndarray())
                    spans += [x for own in part.column("segments").to_pylist() for x in own]
                    frames = round(part.column("end_s")[-1].as_py() / STEP_S)
                    at += len(part)
                out.append(feature(np.concatenate(cube), frames, list(zip(spans[::2], spans[1::2]))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.string())], [*names, "feature"])

    return index.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as audio, and its features as tensors; digests of both, read from what is stored."""
    folder = scratch(docs.sparkSession, "tensors")
    media = store_media(docs, id_col, text_col)
    index = store_tensors(media, folder)
    drop_written(media)
    return read_features(index, folder)


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
