"""Sorted runs of (code, number) in zstd, their merge by a heap, and sums per code.

A run is a zstd stream of frames; a frame holds sorted codes as differences and their numbers, byte by byte of
equal weight, so that the many zero bytes cost nothing. Readers hold one frame of a run at a time.
"""

from __future__ import annotations

import io
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import zstandard

FRAME = 16_384  # entries of a frame
FAN_IN = 64  # runs merged at once


def _planes(column: np.ndarray) -> bytes:
    return np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _column(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, not sorted, as one run of frames."""
    out = zstandard.ZstdCompressor(level=1).compressobj()
    parts = []
    for at in range(0, len(columns[0]), FRAME):
        own = [c[at:at + FRAME] for c in columns]
        parts.append(out.compress(struct.pack("<I", len(own[0])) + b"".join(map(_planes, own))))
    return b"".join(parts) + out.flush()


def unpack(run: bytes, n_columns: int):
    """Frames of a run as lists of columns, decompressed one by one."""
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(run)) as reader:
        while head := reader.read(4):
            n = struct.unpack("<I", head)[0]
            yield [_column(reader.read(8 * n), n) for _ in range(n_columns)]


def pack_sorted(frames) -> bytes:
    """A run from (sorted codes, numbers) pieces."""
    out = zstandard.ZstdCompressor(level=1).compressobj()
    parts = []
    for codes, numbers in frames:
        for at in range(0, len(codes), FRAME):
            c, n = codes[at:at + FRAME].astype("<u8"), numbers[at:at + FRAME]
            parts.append(out.compress(
                struct.pack("<I", len(c)) + _planes(np.diff(c, prepend=np.uint64(0))) + _planes(n)))
    return b"".join(parts) + out.flush()


def unpack_sorted(run: bytes):
    for steps, numbers in unpack(run, 2):
        yield np.cumsum(steps, dtype=np.uint64), numbers


def _add_up(parts):
    codes = np.concatenate([c for c, _ in parts])
    numbers = np.concatenate([n for _, n in parts])
    order = np.argsort(codes, kind="stable")
    codes, numbers = codes[order], numbers[order]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[at], np.add.reduceat(numbers, at)


def merge(runs: list):
    """(codes, sums) in ascending order of all runs; a heap of the last codes of their frames says how far is safe."""
    heads, heap = {}, []
    for i, frames in enumerate(runs):
        if (head := next(frames, None)) is not None:
            heads[i] = head
            heap.append((int(head[0][-1]), i))
    heapify(heap)
    while heap:
        bound, parts = heap[0][0], []
        while heap and heap[0][0] <= bound:
            heappop(heap)
        for i in list(heads):
            codes, numbers = heads[i]
            k = int(np.searchsorted(codes, np.uint64(bound), "right"))
            if k:
                parts.append((codes[:k], numbers[:k]))
            if k < len(codes):
                heads[i] = codes[k:], numbers[k:]
            elif (head := next(runs[i], None)) is not None:
                heads[i] = head
                heappush(heap, (int(head[0][-1]), i))
            else:
                del heads[i]
        yield _add_up(parts)


class RunCounter:
    """Sums per code over any number of runs; at most `FAN_IN` of a level are held before they become one of the next."""

    def __init__(self):
        self.levels = []

    def add(self, run: bytes, level: int = 0):
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FAN_IN:
            held, self.levels[level] = self.levels[level], []
            self.add(pack_sorted(merge([unpack_sorted(r) for r in held])), level + 1)

    def totals(self):
        """(codes, sums), ascending."""
        pieces = list(merge([unpack_sorted(r) for own in self.levels for r in own]))
        if not pieces:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(c) for c in zip(*pieces))
