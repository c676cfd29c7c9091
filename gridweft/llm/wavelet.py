"""Wavelet matrix of one shard of token ids, as bytes of one file."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"GWWM0002"
_HEAD = struct.Struct("<8sIIQQ")  # magic, planes, bytes an id, ids, documents
_BLOCK = 512
#: Bytes of a plane in one zstd frame; an access unpacks a frame of each plane.
_FRAME = 1 << 14


class Plane:
    """The packed bits of one plane, whole or in frames that are unpacked when they are first looked at."""

    def __init__(self, size: int, frames: list[bytes] | None = None, whole: np.ndarray | None = None):
        self.size, self.frames, self.whole, self.open = size, frames, whole, {}

    def frame(self, k: int) -> np.ndarray:
        if k not in self.open:
            self.open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[k]), np.uint8)
        return self.open[k]

    def part(self, low: int, high: int) -> np.ndarray:
        """Bytes from low to high."""
        if self.whole is not None:
            return self.whole[low:high]
        high = min(high, self.size)
        parts = [self.frame(k)[max(0, low - k * _FRAME) : high - k * _FRAME] for k in range(low // _FRAME, -(-high // _FRAME))]
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint8), *parts])

    def every(self) -> np.ndarray:
        if self.whole is None:
            self.whole = self.part(0, self.size)
        return self.whole

    def packed(self) -> list[bytes]:
        packer, plane = zstandard.ZstdCompressor(level=1), self.every()
        return [packer.compress(plane[k : k + _FRAME].tobytes()) for k in range(0, self.size, _FRAME)]


class WaveletMatrix:
    """Bit-planes of ids, most significant first, each stably parted by its bits, zeros first.

    File: head; doc_id and length of each document; zeros of each plane; then of each plane
    the numbers and sizes of its frames, its ones before each block of 512 bits, and the
    frames: its packed bits, so many bytes in each.
    """

    def __init__(self, planes: list[np.ndarray], zeros: np.ndarray, n: int, docs: np.ndarray, lengths: np.ndarray, width: int):
        self.planes, self.zeros, self.n, self.docs, self.lengths, self.width = planes, zeros, n, docs, lengths, width
        self.ones = [self._directory(p) for p in planes]
        self.planes = [Plane(len(p), whole=p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-len(plane) // (_BLOCK // 8)) * (_BLOCK // 8) or _BLOCK // 8, np.uint8)
        padded[: len(plane)] = plane
        counts = np.bitwise_count(padded.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def build(cls, ids: np.ndarray, docs, lengths, bits: int) -> WaveletMatrix:
        planes, zeros, now = [], np.zeros(bits, np.int64), ids
        for level in range(bits):
            bit = (now >> (bits - 1 - level) & 1).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            zeros[level] = len(low)
            after = np.empty_like(now)
            np.take(now, low, out=after[: len(low)], mode="clip")
            np.take(now, high, out=after[len(low) :], mode="clip")
            now = after
        return cls(planes, zeros, len(ids), np.asarray(docs, np.int64), np.asarray(lengths, np.int64), ids.dtype.itemsize)

    def to_bytes(self) -> bytes:
        out = [_HEAD.pack(MAGIC, len(self.planes), self.width, self.n, len(self.docs)), self.docs.tobytes(), self.lengths.tobytes(), self.zeros.tobytes()]
        for plane, ones in zip(self.planes, self.ones, strict=True):
            frames = plane.packed()
            out += [struct.pack("<QQQ", plane.size, len(frames), len(ones)), np.array([len(f) for f in frames], "<u4").tobytes(), ones.astype("<u4").tobytes(), *frames]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, width, n, docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at, arrays = _HEAD.size, []
        for count in (docs, docs, bits):
            arrays.append(np.frombuffer(data, "<i8", count, at))
            at += 8 * count
        self, planes, ones = cls.__new__(cls), [], []
        for _ in range(bits):
            size, count, blocks = struct.unpack_from("<QQQ", data, at)
            sizes = np.frombuffer(data, "<u4", count, at + 24).tolist()
            ones.append(np.frombuffer(data, "<u4", blocks, at + 24 + 4 * count).astype(np.int64))
            at, frames = at + 24 + 4 * (count + blocks), []
            for held in sizes:
                frames.append(data[at : at + held])
                at += held
            planes.append(Plane(size, frames))
        self.planes, self.ones, self.n, self.width = planes, ones, n, width
        self.docs, self.lengths, self.zeros = arrays
        return self

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // _BLOCK
        part = self.planes[level].part(block * _BLOCK // 8, -(-i // 8)) if i % _BLOCK else np.empty(0, np.uint8)
        bits = np.unpackbits(part, bitorder="little")[: i - block * _BLOCK]
        return int(self.ones[level][block]) + int(bits.sum())

    def _bits(self, token: int):
        last = len(self.planes) - 1
        return ((level, token >> (last - level) & 1) for level in range(last + 1))

    def access(self, i: int) -> int:
        token = 0
        for level, plane in enumerate(self.planes):
            bit, ones = int(plane.part(i >> 3, (i >> 3) + 1)[0] >> (i & 7) & 1), self._rank1(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level, bit in self._bits(token):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if bit else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i ids."""
        if token >> len(self.planes):
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def rank_many(self, token: int, i: np.ndarray) -> np.ndarray:
        """Occurrences of token among the first i ids, for each i."""
        if token >> len(self.planes):
            return np.zeros(len(i), np.int64)
        lo, hi = 0, i.astype(np.int64)
        for level, bit in self._bits(token):
            plane = self.planes[level].every()
            words = np.zeros(len(plane) // 8 + 1, np.uint64)
            words.view(np.uint8)[: len(plane)] = plane
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            at = np.append(hi, lo)
            ones = before[at >> 6] + np.bitwise_count(words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            hi, lo = (ones[:-1], int(ones[-1])) if bit else (hi - ones[:-1], lo - int(ones[-1]))
            if bit:
                hi, lo = hi + int(self.zeros[level]), lo + int(self.zeros[level])
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bits(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) bits of this value in a plane; of a block only the bits that are asked for are looked at."""
        ones, plane, width = self.ones[level], self.planes[level].every(), _BLOCK // 8
        before = ones if bit else np.arange(len(ones)) * _BLOCK - ones
        block, out = np.searchsorted(before, k, side="right") - 1, np.empty(len(k), np.int64)
        padded = np.zeros(-(-len(plane) // width) * width, np.uint8)
        padded[: len(plane)] = plane
        blocks = padded.reshape(-1, width)
        for low in range(0, len(k), 4096):
            b = block[low : low + 4096]
            seen = np.cumsum(np.unpackbits(blocks[b], axis=1, bitorder="little") == bit, axis=1, dtype=np.int16)
            out[low : low + 4096] = b * _BLOCK + (seen > (k[low : low + 4096] - before[b])[:, None]).argmax(1)
        return out

    def select_many(self, token: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) occurrences of token."""
        if len(k) and not 0 <= k.min() <= k.max() < self.count(token):
            raise IndexError(f"token {token} has {self.count(token)} occurrences")
        at = self._range(token, 0)[0] + k
        for level, bit in reversed(list(self._bits(token))):
            at = self._select_bits(level, bit, at - (int(self.zeros[level]) if bit else 0))
        return at

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of token."""
        return int(self.select_many(token, np.array([k], np.int64))[0])

    def to_array(self) -> np.ndarray:
        """All ids, planes undone from the last to the first."""
        kind = {2: np.uint16, 4: np.uint32}[self.width]
        now = np.zeros(self.n, kind)
        last = len(self.planes) - 1
        for level in range(last, -1, -1):
            bit = np.unpackbits(self.planes[level].every(), count=self.n, bitorder="little").view(bool)
            zeros, before = int(self.zeros[level]), np.empty_like(now)
            before[np.flatnonzero(~bit)] = now[:zeros]
            before[np.flatnonzero(bit)] = now[zeros:] | kind(1 << (last - level))
            now = before
        return now
