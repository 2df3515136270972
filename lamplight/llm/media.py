"""Media columns: AVI files of motion-JPEG frames, read back, decoded and cut into shots.

Any AVI file with a motion-JPEG stream is read: frames are found by the index, whose
offsets may count from the file's start or from its list of frames, or without an index by
walking that list; entries of other streams (sound) are passed over; an empty frame repeats
the one before.  `jpeg` decodes the frames.

Texts are stored as such files: grey 24 x 24 intra frames of lossless JPEG (predictor 1), so
that bytes stored as samples come back exactly.  The encoder's Huffman table gives a
difference of s bits a code of 9 - s bits: every sample then takes nine bits, an eighth
more than raw, and a whole stack of frames is coded and decoded by array operations.

A shot ends where the distance of neighbouring frames' grey histograms exceeds the mean
of the distances around it by three standard deviations and a floor.

Cases: a null text is empty; an empty payload is one frame of padding; very long texts are
coded a block of frames at a time; equal rows have equal files; equal histogram steps (ties)
are cut alike; an empty table gives an empty result; extra columns are left out, and ones
that clash with a result don't reach it; null media give null facts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamplight.llm import jpeg

SIDE = 24
FRAME = SIDE * SIDE
PAD = 255
FPS = 25
BINS = 16
#: Frames that are coded or decoded at once; bounds memory for very long payloads.
BLOCK = 2048


def padded(data: bytes) -> bytes:
    """data with padding up to a positive multiple of a frame's samples."""
    return data + bytes([PAD]) * (-len(data) % FRAME if data else FRAME)


def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit code of each difference -255 to 255, and the difference of each code."""
    codes, back = np.zeros(511, dtype=np.uint16), np.zeros(512, dtype=np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        codes[d + 255] = ((1 << (8 - s)) - 1) << (s + 1) | (d if d >= 0 else d + (1 << s) - 1)
        back[codes[d + 255]] = d
    return codes, back


CODES, DIFFERENCES = code_tables()
#: One code of each length from 1 to 9 bits; the longer the code the fewer bits follow it.
LENGTHS = bytes([1] * 9 + [0] * 7)
SYMBOLS = bytes(range(8, -1, -1))


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


FRAME_HEAD = (
    b"\xff\xd8"
    + segment(0xC4, b"\x00" + LENGTHS + SYMBOLS)
    + segment(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))
)


def differences(frames: np.ndarray) -> np.ndarray:
    """Samples less their prediction: the left one, for a row's first the one above, for the very first 128."""
    f = frames.astype(np.int16)
    d = np.empty_like(f)
    d[:, :, 1:] = f[:, :, 1:] - f[:, :, :-1]
    d[:, 1:, 0] = f[:, 1:, 0] - f[:, :-1, 0]
    d[:, 0, 0] = f[:, 0, 0] - 128
    return d


def samples(d: np.ndarray) -> np.ndarray:
    """Samples of differences, modulo 65536 as the standard has it."""
    d = d.astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 0xFFFF).astype(np.uint8)


def encoded_frames(payload: bytes) -> Iterator[bytes]:
    """A JPEG of each frame."""
    stack = np.frombuffer(payload, dtype=np.uint8).reshape(-1, SIDE, SIDE)
    for at in range(0, len(stack), BLOCK):
        d = differences(stack[at : at + BLOCK])
        codes = CODES[d.reshape(len(d), -1, 8) + 255]
        out = np.empty((*codes.shape[:2], 9), dtype=np.uint8)  # eight codes are nine bytes
        out[:, :, 0] = codes[:, :, 0] >> 1
        for k in range(1, 8):
            out[:, :, k] = (codes[:, :, k - 1] & ((1 << k) - 1)) << (8 - k) | codes[:, :, k] >> (k + 1)
        out[:, :, 8] = codes[:, :, 7] & 0xFF
        for scan in out.reshape(len(d), -1):
            yield FRAME_HEAD + scan.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def avi_file(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI file whose frames hold the padded payload."""
    frames = list(encoded_frames(payload))
    most = max(map(len, frames))
    head = chunk(b"avih", struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0))
    stream = chunk(b"strh", b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0, 0, 0, 0, SIDE, SIDE))
    stream += chunk(b"strf", struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0))
    movi, places, at = [b"movi"], [], 4
    for f in frames:
        places.append((at, len(f)))
        movi.append(chunk(b"00dc", f))
        at += len(movi[-1])
    index = b"".join(b"00dc" + struct.pack("<III", 0x10, a, n) for a, n in places)
    body = b"AVI " + chunk(b"LIST", b"hdrl" + head + chunk(b"LIST", b"strl" + stream)) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", index)
    return b"RIFF" + struct.pack("<I", len(body)) + body


class Video(NamedTuple):
    fps: float
    frames: list[memoryview]


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of each RIFF chunk in a range; lists are named by their kind."""
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name in (b"LIST", b"RIFF"):
            yield data[at + 8 : at + 12], at + 12, n - 4
        else:
            yield name, at + 8, n
        at += 8 + n + n % 2


def parse_avi(data: bytes) -> Video:
    """Frames of an AVI file's first motion-JPEG stream."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    view, movi, size, fps, index, stream, streams = memoryview(data), 0, 0, 0.0, None, -1, 0
    for name, start, n in chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        if name == b"hdrl":
            for inner, at, m in chunks(data, start, start + n):
                if inner == b"avih" and not fps:
                    micros = struct.unpack_from("<I", data, at)[0]
                    fps = 1e6 / micros if micros else 0.0
                elif inner == b"strl":
                    for part, place, _ in chunks(data, at, at + m):
                        if part == b"strh" and data[place : place + 4] == b"vids" and stream < 0:
                            stream, (scale, rate) = streams, struct.unpack_from("<II", data, place + 20)
                            fps = rate / scale if scale and rate else fps
                    streams += 1
        elif name == b"movi":
            movi, size = start - 4, n
        elif name == b"idx1":
            index = data[start : start + n]
    names = {f"{max(stream, 0):02d}{kind}".encode() for kind in ("dc", "db")}
    if index is None:
        found = walk(data, movi + 4, movi + 4 + size, names)
    else:
        entries = np.frombuffer(index, dtype=[("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")])
        entries = entries[np.isin(entries["id"], list(names))]
        base = movi if len(entries) and data[movi + int(entries["at"][0]) :][:4] in names else 0
        found = zip((entries["at"].astype(np.int64) + base + 8).tolist(), entries["n"].tolist(), strict=True)
    frames: list[memoryview] = []
    for at, n in found:
        if n or frames:
            frames.append(view[at : at + n] if n else frames[-1])
    return Video(fps, frames)


def walk(data: bytes, at: int, end: int, names: set[bytes]) -> Iterator[tuple[int, int]]:
    """(start, size) of the frames in a list without an index, which may hold lists of records."""
    for name, start, n in chunks(data, at, end):
        if name == b"rec ":
            yield from walk(data, start, start + n, names)
        elif name in names:
            yield start, n


def decoded(video: Video) -> Iterator[np.ndarray]:
    """Stacks of the frames' grey samples; the frames of a stack are of one size."""
    for at in range(0, len(video.frames), BLOCK):
        group = [bytes(f) for f in video.frames[at : at + BLOCK]]
        if all(g.startswith(FRAME_HEAD) for g in group):
            joined = b"".join(g[len(FRAME_HEAD) : -2].replace(b"\xff\x00", b"\xff") for g in group)
            raw = np.frombuffer(joined, dtype=np.uint8).reshape(len(group), -1, 9).astype(np.uint16)
            codes = np.empty((*raw.shape[:2], 8), dtype=np.uint16)
            for k in range(8):
                codes[:, :, k] = (raw[:, :, k] & ((1 << (8 - k)) - 1)) << (k + 1) | raw[:, :, k + 1] >> (7 - k)
            yield samples(DIFFERENCES[codes].reshape(len(group), SIDE, SIDE))
        else:
            for _, same in groupby((jpeg.decode(g)[..., 0] for g in group), key=lambda f: f.shape):
                yield np.stack(list(same))


def histograms(frames: np.ndarray) -> np.ndarray:
    """Grey histogram of each frame."""
    n = len(frames)
    places = (frames.reshape(n, -1) >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(places.ravel(), minlength=n * BINS).reshape(n, BINS)


def shot_starts(hist: np.ndarray, around: int = 12, factor: float = 3.0, floor: float = 0.15) -> np.ndarray:
    """First frames of shots: where a histogram differs from the one before by more than its surroundings let expect."""
    if len(hist) < 2:
        return np.zeros(min(len(hist), 1), dtype=np.int64)
    step = np.abs(np.diff(hist / hist.sum(axis=1, keepdims=True), axis=0)).sum(axis=1) / 2.0
    places = np.arange(len(step))
    low, high = np.maximum(places - around, 0), np.minimum(places + around + 1, len(step))
    total, squares = np.concatenate([[0], np.cumsum(step)]), np.concatenate([[0], np.cumsum(step**2)])
    n = np.maximum(high - low - 1, 1)
    mean = (total[high] - total[low] - step) / n
    spread = np.sqrt(np.maximum((squares[high] - squares[low] - step**2) / n - mean**2, 0))
    return np.concatenate([[0], np.flatnonzero(step > np.maximum(mean + factor * spread, floor)) + 1])


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """(id, media): each text's AVI file."""
    schema = T.StructType([docs.schema[id_col], T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                files = [avi_file(padded((x.as_py() or "").encode())) for x in batch.column(text_col)]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(files, pa.binary())], names=schema.fieldNames())

    return docs.select(id_col, text_col).mapInArrow(run, schema)


FACTS = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("clips", T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("frames", T.LongType())]))),
    ]
)


def facts(data: bytes) -> tuple:
    """What the stored bytes say: of the payload read back, of the file, and its shots."""
    video = parse_avi(data)
    digest, hists, n, tail, padding = hashlib.sha256(), [], 0, b"", 0
    for stack in decoded(video):
        part = stack.tobytes()
        digest.update(part)
        hists.append(histograms(stack))
        n += len(part)
        tail = part[-FRAME:]
    while padding < len(tail) and tail[-1 - padding] == PAD:
        padding += 1  # UTF-8 has no byte 255
    hist = np.concatenate([np.zeros((0, BINS), dtype=np.int64), *hists])
    starts = shot_starts(hist)
    ends = [*starts[1:].tolist(), len(hist)]
    fps = video.fps or float(FPS)
    clips = [(a / fps, b / fps, b - a) for a, b in zip(starts.tolist(), ends, strict=False)]
    grey = "".join(f"{x:02x}" for x in (hist.sum(axis=0) * 255 // max(hist.sum(), 1)).tolist())
    feature = f"frames={len(hist)};shots={len(starts)};cuts={zlib.crc32(starts.astype('<i8').tobytes()):08x};grey={grey}"
    return n - padding, n, digest.hexdigest(), zlib.crc32(tail[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, clips


def media_facts(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id and FACTS of each stored file."""
    schema = T.StructType([media.schema[id_col], *FACTS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip]
        for batch in batches:
            found = [facts(x.as_py()) if x.is_valid else (None,) * len(types) for x in batch.column(media_col)]
            columns = list(zip(*found, strict=True)) if found else [[] for _ in types]
            columns[-1] = [[dict(zip(("start_s", "end_s", "frames"), c, strict=True)) for c in clips] if clips is not None else None for clips in columns[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.fieldNames())

    return media.select(id_col, media_col).mapInArrow(run, schema)


def clip_rows(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per shot: id, clip (from 0), start_s, end_s, frames."""
    return found.select(id_col, F.posexplode("clips").alias("clip", "c")).select(id_col, "clip", "c.*")
