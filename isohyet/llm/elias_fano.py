"""Elias-Fano coded ascending sequences in flat arrays, read vectorised.

A sequence of n numbers below u keeps the low ``bits`` of each number packed
side by side, and the high parts in unary: for the i-th number with high part h
the bit h + i is set. A count of set bits before every 64-bit word, and the word
of every 32nd set and unset bit, make selection a short search. All arrays can
be views of one memory-mapped file.
"""

from __future__ import annotations

import json
import mmap
import tempfile

import numpy as np
import pyarrow.fs as pafs

STEP = 32


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << shift)
        over = shift + np.uint64(bits) > np.uint64(64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of an ascending sequence (repeats allowed) below ``universe``."""
    values, n = values.astype(np.uint64), len(values)
    bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    low = values & np.uint64((1 << bits) - 1)
    high = (values >> np.uint64(bits)).astype(np.int64)
    size = n + (max(1, universe) >> bits) + 2
    flags = np.zeros(-(-size // 64) * 64, np.uint8)
    flags[high + np.arange(n)] = 1
    upper = np.packbits(flags, bitorder="little").view("<u8")
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)])
    words = lambda x: np.append(np.flatnonzero(x)[::STEP] >> 6, len(upper) - 1).astype(np.uint32)
    return {"meta": np.array([n, bits, universe], np.uint64), "low": _packed(low, bits), "upper": upper, "before": before.astype(np.uint64), "ones": words(flags == 1), "zeros": words(flags == 0)}


def _unpacked(low: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), np.uint64)
    at = i.astype(np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    out = low[word] >> shift
    over = np.flatnonzero(shift > np.uint64(64 - bits))
    out[over] |= low[word[over] + 1] << (np.uint64(64) - shift[over])
    return out & np.uint64((1 << bits) - 1)


def pack(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of numbers below ``universe`` in as many bits each as that takes."""
    bits = max(1, (max(1, universe) - 1).bit_length())
    return {"meta": np.array([len(values), bits], np.uint64), "low": _packed(values.astype(np.uint64), bits)}


class Packed:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["meta"])
        self.low = arrays["low"]

    def find(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of each value between lo and hi (exclusive), where the numbers
        ascend; -1 where it is absent."""
        values, lo, end = values.astype(np.uint64), lo.copy(), hi
        out = np.full(len(values), -1, np.int64)
        todo = np.flatnonzero(hi - lo > 1)
        hi = hi.copy()
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            after = _unpacked(self.low, self.bits, mid) > values[todo]
            lo[todo] = np.where(after, lo[todo], mid)
            hi[todo] = np.where(after, mid, hi[todo])
            todo = todo[hi[todo] - lo[todo] > 1]
        there = np.flatnonzero(lo < end)
        there = there[_unpacked(self.low, self.bits, lo[there]) == values[there]]
        out[there] = lo[there]
        return out


_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the k-th set bit of every byte, at byte * 8 + k.
_IN_BYTE = np.array([([b for b in range(8) if byte >> b & 1] + [8] * 8)[k] for byte in range(256) for k in range(8)], np.uint8)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word."""
    x = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
    x = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES  # set bits up to each byte
    at = np.bitwise_count((((k * _ONES) | _TOPS) - x) & _TOPS).astype(np.uint64) << np.uint64(3)  # whole bytes before
    rest = k - (((x << np.uint64(8)) >> at) & np.uint64(0xFF))
    byte = (word >> at) & np.uint64(0xFF)
    return at.astype(np.int64) + _IN_BYTE[((byte << np.uint64(3)) + rest).astype(np.int64)]


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits, self.universe = (int(x) for x in arrays["meta"])
        self.low, self.upper, self.before = arrays["low"], arrays["upper"], arrays["before"]
        self.samples = {1: arrays["ones"], 0: arrays["zeros"]}

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th (from 0) bit of this value."""
        def count(word: np.ndarray) -> np.ndarray:
            ones = self.before[word].astype(np.int64)
            return ones if bit else word * 64 - ones

        sample = self.samples[bit]
        lo = sample[k // STEP].astype(np.int64)
        hi = sample[np.minimum(k // STEP + 1, len(sample) - 1)].astype(np.int64) + 1
        todo = np.flatnonzero(hi - lo > 1)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            right = count(mid) <= k[todo]
            lo[todo] = np.where(right, mid, lo[todo])
            hi[todo] = np.where(right, hi[todo], mid)
            todo = todo[hi[todo] - lo[todo] > 1]
        word = self.upper[lo] if bit else ~self.upper[lo]
        return lo * 64 + _select_in_word(word, (k - count(lo)).astype(np.uint64))

    def _next(self, place: np.ndarray, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the first bit of this value from ``place`` on, which is the
        k-th: in the same word most often, else selected."""
        word = self.upper[place >> 6]
        rest = (word if bit else ~word) >> (place & 63).astype(np.uint64)
        out = place + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        if len(far):
            out[far] = self._select(k[far], bit)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        high = (self._select(i, 1) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | _unpacked(self.low, self.bits, i)

    def between(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th numbers and those after them: of pointers, the range."""
        at = self._select(i, 1)
        high = np.stack([at - i, self._next(at + 1, i + 1, 1) - i - 1]).astype(np.uint64) << np.uint64(self.bits)
        return ((high[0] | _unpacked(self.low, self.bits, i)).astype(np.int64), (high[1] | _unpacked(self.low, self.bits, i + 1)).astype(np.int64))

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of each value, -1 where it is absent (first of repeats); with
        ``first`` and ``last`` (exclusive), only between these indices."""
        values = values.astype(np.uint64)
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        inside = np.flatnonzero(values < np.uint64(self.universe))
        high = (values[inside] >> np.uint64(self.bits)).astype(np.int64)
        low = values[inside] & np.uint64((1 << self.bits) - 1)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) + 1, 0)
        lo, hi = start - high, self._next(start, high, 0) - high
        if first is not None and last is not None:
            lo, hi = np.maximum(lo, first[inside]), np.minimum(hi, last[inside])
        end = hi.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            right = _unpacked(self.low, self.bits, mid) < low[todo]
            lo[todo] = np.where(right, mid + 1, lo[todo])
            hi[todo] = np.where(right, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        there = np.flatnonzero(lo < end)
        there = there[_unpacked(self.low, self.bits, lo[there]) == low[there]]
        out[inside[there]] = lo[there]
        return out


def quantised(logs: np.ndarray, quantum: float) -> dict[str, np.ndarray]:
    """Arrays of logs of probabilities, as multiples of ``quantum`` rounded down:
    of one byte each where there are few different ones."""
    steps = np.minimum(np.ceil(-logs / quantum), 65535).astype(np.uint16)
    table = np.flatnonzero(np.bincount(steps, minlength=1)).astype(np.uint16)
    if len(table) > 256:
        return {"code": steps, "table": np.zeros(0, np.uint16)}
    place = np.zeros(65536, np.uint8)
    place[table] = np.arange(len(table))
    return {"code": place[steps], "table": table}


def probability(arrays: dict[str, np.ndarray], name: str, i: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """The numbers of which ``quantised`` kept logs; ``powers`` has that of every
    multiple of the quantum."""
    code, table = arrays[f"{name}.code"][i], arrays[f"{name}.table"]
    return powers[table][code] if len(table) else powers[code]


class Writer:
    """A file of named arrays, written one after another; the list of names is
    at its end. A repeated task replaces the file by an equal one."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.part = f"{self.path}.{np.random.default_rng().integers(1 << 62):x}.part"
        self.out, self.at, self.names = self.fs.open_output_stream(self.part), 0, {}

    def add(self, arrays: dict[str, np.ndarray]) -> None:
        for k, v in arrays.items():
            v = np.ascontiguousarray(v)
            self.names[k] = [v.dtype.str, len(v), self.at]
            self.out.write(v.tobytes() + b"\0" * (-v.nbytes % 8))
            self.at += -(-v.nbytes // 8) * 8

    def close(self) -> None:
        text = json.dumps(self.names).encode()
        self.out.write(text + len(text).to_bytes(8, "little"))
        self.out.close()
        self.fs.move(self.part, self.path)


def write(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays."""
    out = Writer(uri)
    out.add(arrays)
    out.close()


def mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file as views of its memory map. A file that is not on
    a mounted file system is first copied to an unnamed local one."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)  # maps outnumber the open files allowed
    else:
        with fs.open_input_stream(path) as f, tempfile.TemporaryFile() as copy:
            while chunk := f.read(1 << 24):
                copy.write(chunk)
            copy.flush()
            data = mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    end = len(data) - 8
    size = int.from_bytes(data[end:], "little")
    return {k: np.frombuffer(data, np.dtype(t), n, at) for k, (t, n, at) in json.loads(data[end - size : end]).items()}


def part(arrays: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    return {k.removeprefix(f"{name}."): v for k, v in arrays.items() if k.startswith(f"{name}.")}


def sequence(arrays: dict[str, np.ndarray], name: str) -> Sequence:
    return Sequence(part(arrays, name))


def named(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in arrays.items()}
