"""FLAC streams: the header, and samples of whole files."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: codes of block sizes and sample sizes, and the weights of its fixed predictors.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
SAMPLE_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
HEADER_BYTES = 42


@dataclass(frozen=True)
class StreamInfo:
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes


def stream_info(head: bytes) -> StreamInfo:
    """What the first HEADER_BYTES of a file say."""
    if len(head) < HEADER_BYTES or head[:4] != b"fLaC" or head[4] & 127:
        raise ValueError("no FLAC stream")
    fields = int.from_bytes(head[18:26], "big")
    return StreamInfo(fields >> 44, (fields >> 41 & 7) + 1, (fields >> 36 & 31) + 1, fields & (1 << 36) - 1, head[26:42])


class Bits:
    """Numbers from bytes, bit by bit, the highest first."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise ValueError("the stream ends in a frame")
        value = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at - n) & (1 << n) - 1
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.read(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def zeros(self) -> int:
        """How many zeros come before the next one, which is read too."""
        count = 0
        while True:
            first = self.at >> 3
            part = self.data[first : first + 9]
            if not part:
                raise ValueError("the stream ends in a frame")
            left = len(part) * 8 - (self.at & 7)
            window = int.from_bytes(part, "big") & (1 << left) - 1
            if window:
                run = left - window.bit_length()
                self.at += run + 1
                return count + run
            count += left
            self.at += left


def _residual(bits: Bits, size: int, order: int) -> list[int]:
    """The differences from a prediction, in parts with a Rice parameter each."""
    wide = (4, 5)[bits.read(2)]
    parts = bits.read(4)
    out: list[int] = []
    for part in range(1 << parts):
        n = (size >> parts) - (order if part == 0 else 0)
        k = bits.read(wide)
        if k == (1 << wide) - 1:
            raw = bits.read(5)
            out += [bits.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            value = bits.zeros() << k
            if k:
                value |= bits.read(k)
            out.append(value >> 1 ^ -(value & 1))
    return out


def _subframe(bits: Bits, size: int, depth: int) -> np.ndarray:
    if bits.read(1):
        raise ValueError("a subframe doesn't begin with 0")
    kind = bits.read(6)
    wasted = bits.zeros() + 1 if bits.read(1) else 0
    depth -= wasted
    if kind == 0:
        out = np.full(size, bits.signed(depth), np.int64)
    elif kind == 1:
        out = np.array([bits.signed(depth) for _ in range(size)], np.int64)
    elif 8 <= kind <= 12:
        order = kind - 8
        first = np.array([bits.signed(depth) for _ in range(order)], np.int64)
        out = np.array(_residual(bits, size, order), np.int64)
        for times in reversed(range(order)):  # sums undo differences, from where each stands at the end of the first samples
            out = np.diff(first, times)[-1] + np.cumsum(out)
        out = np.concatenate([first, out])
    elif kind >= 32:
        order = kind - 31
        made = [bits.signed(depth) for _ in range(order)]
        precision, shift = bits.read(4) + 1, bits.signed(5)
        weights = [bits.signed(precision) for _ in range(order)][::-1]
        for difference in _residual(bits, size, order):
            made.append(difference + (sum(w * x for w, x in zip(weights, made[-order:])) >> shift))
        out = np.array(made, np.int64)
    else:
        raise ValueError(f"no kind of subframe: {kind}")
    return out << wasted


def _frame(bits: Bits, info: StreamInfo) -> np.ndarray:
    """Samples of a frame, a row for each channel."""
    if bits.read(14) != 0x3FFE:
        raise ValueError("no frame where one should begin")
    bits.read(2)
    size, rate, channels, depth = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
    bits.read(1)
    number = bits.read(8)
    more = 0
    while number << more & 0x80:
        more += 1
    for _ in range(max(0, more - 1)):
        bits.read(8)
    size = BLOCK_SIZES.get(size) or bits.read(8 if size == 6 else 16) + 1
    bits.read({12: 8, 13: 16, 14: 16}.get(rate, 0))
    bits.read(8)
    depth = SAMPLE_SIZES.get(depth, info.bits)
    if channels < 8:
        out = np.stack([_subframe(bits, size, depth) for _ in range(channels + 1)])
    else:  # one of two channels is the difference of both, which takes a bit more
        a, b = (_subframe(bits, size, depth + (channels == (9, 8)[i] or (i == 1 and channels == 10))) for i in range(2))
        if channels == 8:
            out = np.stack([a, a - b])
        elif channels == 9:
            out = np.stack([a + b, b])
        else:
            middle = (a << 1) + (b & 1)
            out = np.stack([(middle + b) >> 1, (middle - b) >> 1])
    bits.at = (bits.at + 7) // 8 * 8
    bits.read(16)
    return out


def decode(data: bytes) -> tuple[np.ndarray, StreamInfo]:
    """Whole-numbered samples, a row for each channel, and the header; a stream whose samples don't have its digest raises."""
    info, at = stream_info(data[:HEADER_BYTES]), 4
    while True:
        last, long = data[at] >> 7, int.from_bytes(data[at + 1 : at + 4], "big")
        at += 4 + long
        if last:
            break
    bits, frames = Bits(data, at), []
    while bits.at < len(data) * 8 and (not info.samples or sum(f.shape[1] for f in frames) < info.samples):
        frames.append(_frame(bits, info))
    out = np.concatenate(frames, axis=1) if frames else np.zeros((info.channels, 0), np.int64)
    if info.samples and out.shape[1] != info.samples:
        raise ValueError(f"{out.shape[1]} samples of {info.samples}")
    wide = (info.bits + 7) // 8
    raw = out.T.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :wide].tobytes()
    if any(info.md5) and hashlib.md5(raw).digest() != info.md5:
        raise ValueError("samples don't have the stream's digest")
    return out, info
