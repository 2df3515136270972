"""Frames of motion-JPEG: sequential Huffman JPEG (baseline, extended) and lossless JPEG with predictor 1.

A frame may have one or three components of any sampling (4:4:4, 4:2:2, 4:2:0), its own
Huffman tables or none (then the usual ones, as in motion-JPEG), restart markers, and one
scan for all components or several.  Progressive and arithmetic coding are refused.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np


def by_tens(*rows: tuple[int, int, int]) -> list[int]:
    """Run and size symbols row*16 + first .. row*16 + last."""
    return [16 * row + x for row, first, last in rows for x in range(first, last + 1)]


# The Huffman tables that the JPEG standard gives as typical, which motion-JPEG frames without tables use.
DC_LENGTHS = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]))
DC_SYMBOLS = bytes(range(12))
AC_LENGTHS = (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]))
AC_SYMBOLS = (
    bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a")
    + bytes(by_tens((1, 6, 10), (2, 5, 10), (3, 4, 10), *((k, 3, 10) for k in range(4, 9)), *((k, 2, 10) for k in range(9, 14)), (14, 1, 10), (15, 1, 10))),
    bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1")
    + bytes(by_tens((1, 7, 10), (2, 6, 10), (3, 5, 10), *((k, 3, 10) for k in range(4, 8)), *((k, 2, 10) for k in range(8, 15)), (15, 2, 10))),
)
USUAL = {(0, 0): (DC_LENGTHS[0], DC_SYMBOLS), (0, 1): (DC_LENGTHS[1], DC_SYMBOLS), (1, 0): (AC_LENGTHS[0], AC_SYMBOLS[0]), (1, 1): (AC_LENGTHS[1], AC_SYMBOLS[1])}

#: Place of each coefficient of the stream in its block: along the diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


class Part(NamedTuple):
    """A component: its name in the file, sampling factors and quantiser."""

    name: int
    across: int
    down: int
    quantiser: int


class Scan(NamedTuple):
    parts: list[tuple[int, int, int]]  # component name, table for its first coefficients, for the others
    predictor: int
    data: bytes


class Frame(NamedTuple):
    kind: int
    width: int
    height: int
    parts: list[Part]
    tables: dict[tuple[int, int], tuple[bytes, bytes]]
    quantisers: dict[int, np.ndarray]
    restart: int
    scans: list[Scan]


def scan_end(data: bytes, at: int) -> int:
    """Where the marker stands that ends the scan beginning at `at`."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def parse_frame(data: bytes) -> Frame:
    """Tables and scans of a JPEG file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, kind, width, height, parts, restart = 2, 0, 0, 0, [], 0
    tables, quantisers, scans = dict(USUAL), {}, []
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] == 0xFF:  # fill bytes
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xD9:
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (bytes(body[1:17]), bytes(body[17 : 17 + count]))
                body = body[17 + count :]
        elif marker == 0xDB:
            while body:
                size = 128 if body[0] >> 4 else 64
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + size], dtype=">u2" if size == 128 else "u1").astype(np.int64)
                body = body[1 + size :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            if body[0] != 8:
                raise ValueError(f"samples of {body[0]} bits")
            kind, (height, width) = marker, struct.unpack_from(">HH", body, 1)
            parts = [Part(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"progressive, hierarchical or arithmetic frame: marker {marker:02x}")
        elif marker == 0xDA:
            end = scan_end(data, at)
            chosen = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            scans.append(Scan(chosen, body[1 + 2 * body[0]], data[at:end]))
            at = end
    if not parts or not scans:
        raise ValueError("a JPEG frame without size or scan")
    return Frame(kind, width, height, parts, tables, quantisers, restart, scans)


def huffman_codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    code, k, out = 0, 0, {}
    for n in range(16):
        for _ in range(lengths[n]):
            out[(n + 1, code)] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=16)
def lookup(lengths: bytes, symbols: bytes) -> list[int]:
    """By the next sixteen bits: length of the code they begin with, times 256, and its symbol; 0 if there is none."""
    table = np.zeros(1 << 16, dtype=np.int64)
    for (n, code), symbol in huffman_codes(lengths, symbols).items():
        table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
    return table.tolist()


def intervals(scan: bytes) -> list[bytes]:
    """Entropy-coded data between restart markers, without stuffing, and some bytes to look ahead into."""
    out, last, at = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        if 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[last:at])
            last = at + 2
        at += 2
    return [x.replace(b"\xff\x00", b"\xff") + bytes(8) for x in [*out, scan[last:]]]


def blocks_of(data: bytes, order: list[tuple[np.ndarray, int, list[int], list[int]]], before: dict[int, int]) -> None:
    """Decode the coefficients of blocks, given in the order of the stream as (coefficients, component, its two tables)."""
    at, end = 0, 8 * (len(data) - 8)
    for out, part, first, others in order:
        k = 0
        while k < 64:
            i = at >> 3
            found = (first if k == 0 else others)[((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) >> (8 - (at & 7))) & 0xFFFF]
            if not found or at > end:
                raise ValueError("a scan that breaks off or has an unknown code")
            at, symbol = at + (found >> 8), found & 255
            if k:
                run, size = symbol >> 4, symbol & 15
                if not size:
                    if run < 15:
                        break
                    k += 16
                    continue
                k += run
            else:
                size = symbol
            value = 0
            if size:
                i = at >> 3
                value = (int.from_bytes(data[i : i + 4], "big") >> (32 - (at & 7) - size)) & ((1 << size) - 1)
                at += size
                if not value >> (size - 1):
                    value -= (1 << size) - 1
            if k == 0:
                value = before[part] = before.get(part, 0) + value
            elif k > 63:
                raise ValueError("more than 64 coefficients in a block")
            out[k] = value
            k += 1


def planes(frame: Frame) -> list[np.ndarray]:
    """Samples of each component of a sequential frame, at its own sampling."""
    most_across, most_down = max(p.across for p in frame.parts), max(p.down for p in frame.parts)
    mcus_across, mcus_down = -(-frame.width // (8 * most_across)), -(-frame.height // (8 * most_down))
    number = {p.name: i for i, p in enumerate(frame.parts)}
    coefficients = [np.zeros((mcus_down * p.down, mcus_across * p.across, 64), dtype=np.int64) for p in frame.parts]
    for scan in frame.scans:
        with_tables = [(number[name], lookup(*frame.tables[0, a]), lookup(*frame.tables[1, b])) for name, a, b in scan.parts]
        if len(with_tables) == 1:
            i, first, others = with_tables[0]
            p = frame.parts[i]
            across, down = -(-frame.width * p.across // (8 * most_across)), -(-frame.height * p.down // (8 * most_down))
            mcus = [[(coefficients[i][y, x], i, first, others)] for y in range(down) for x in range(across)]
        else:
            mcus = [
                [
                    (coefficients[i][y * frame.parts[i].down + v, x * frame.parts[i].across + u], i, first, others)
                    for i, first, others in with_tables
                    for v in range(frame.parts[i].down)
                    for u in range(frame.parts[i].across)
                ]
                for y in range(mcus_down)
                for x in range(mcus_across)
            ]
        step = frame.restart or len(mcus)
        for n, data in enumerate(intervals(scan.data)):
            blocks_of(data, [b for mcu in mcus[n * step : (n + 1) * step] for b in mcu], {})
    out = []
    for p, c in zip(frame.parts, coefficients, strict=True):
        grid = np.zeros(c.shape)
        grid[..., ZIGZAG] = c * frame.quantisers[p.quantiser]
        values = COSINES.T @ grid.reshape(*c.shape[:2], 8, 8) @ COSINES + 128
        whole = np.clip(np.rint(values), 0, 255).astype(np.uint8).swapaxes(1, 2).reshape(8 * c.shape[0], 8 * c.shape[1])
        out.append(whole[: -(-frame.height * p.down // most_down), : -(-frame.width * p.across // most_across)])
    return out


def lossless_plane(frame: Frame) -> np.ndarray:
    """Samples of a lossless frame of one component."""
    if len(frame.parts) != 1 or frame.scans[0].predictor != 1 or frame.restart:
        raise ValueError("lossless frames: one component, predictor 1, no restarts")
    table, data, at, out = lookup(*frame.tables[0, frame.scans[0].parts[0][1]]), intervals(frame.scans[0].data)[0], 0, []
    for _ in range(frame.width * frame.height):
        i = at >> 3
        found = table[((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) >> (8 - (at & 7))) & 0xFFFF]
        if not found or at > 8 * (len(data) - 8):
            raise ValueError("a scan that breaks off or has an unknown code")
        at, size, value = at + (found >> 8), found & 255, 0
        if size:
            i = at >> 3
            value = (int.from_bytes(data[i : i + 4], "big") >> (32 - (at & 7) - size)) & ((1 << size) - 1)
            at += size
            if not value >> (size - 1):
                value -= (1 << size) - 1
        out.append(value)
    d = np.array(out, dtype=np.int64).reshape(frame.height, frame.width)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return (np.cumsum(d, axis=1) & 0xFFFF).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Samples of a frame (height, width, components), as stored: grey, or luma and two chromas."""
    frame = parse_frame(data)
    if frame.kind == 0xC3:
        return lossless_plane(frame)[..., None]
    found = planes(frame)
    full = []
    for p, plane in zip(frame.parts, found, strict=True):
        across, down = max(q.across for q in frame.parts) // p.across, max(q.down for q in frame.parts) // p.down
        full.append(plane.repeat(down, axis=0).repeat(across, axis=1)[: frame.height, : frame.width])
    return np.stack(full, axis=-1)


def to_rgb(samples: np.ndarray) -> np.ndarray:
    """Red, green and blue of decoded samples."""
    if samples.shape[-1] == 1:
        return samples.repeat(3, axis=-1)
    y, b, r = (samples[..., k].astype(np.float64) - (128 if k else 0) for k in range(3))
    return np.clip(np.rint(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=-1)), 0, 255).astype(np.uint8)
