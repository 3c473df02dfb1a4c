"""What a JPEG file says without being rendered: its tables, its size and the quantized luma coefficients of a baseline scan."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Blocks that are read at most; enough for a histogram.
BLOCKS = 3000


class Unsupported(ValueError):
    """The file is no baseline JPEG."""


def _zigzag() -> np.ndarray:
    """Place (row by row) of each coefficient in the order of a scan: diagonals, every other one upwards."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


@dataclass
class Component:
    number: int
    across: int
    down: int
    quantizer: int
    dc: int = 0
    ac: int = 0


@dataclass
class Header:
    width: int = 0
    height: int = 0
    baseline: bool = False
    components: list[Component] = field(default_factory=list)
    quantizers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    restart: int = 0
    scan: int = 0  # where the coded data start
    exif: bytes = b""


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For all 16 bits that may come next: length of the code among them and its symbol; length 0 where there is none."""
    table = np.zeros((1 << 16, 2), dtype=np.uint8)
    at, used = 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[used : used + n]:
            span = 1 << (16 - length)
            table[at : at + span] = (length, symbol)
            at += span
        used += n
    return table


def header(data: bytes) -> Header:
    """All segments before the first scan."""
    if data[:2] != b"\xff\xd8":
        raise Unsupported("no JPEG")
    out, at = Header(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Unsupported("no marker where one should be")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                out.quantizers[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                out.codes[(body[0] >> 4, body[0] & 15)] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            out.baseline = kind in (0xC0, 0xC1) and body[0] == 8
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.components = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif kind == 0xDD:
            out.restart = int.from_bytes(body[:2], "big")
        elif kind == 0xE1 and body[:6] == b"Exif\0\0":
            out.exif = bytes(body[6:])
        elif kind == 0xDA:
            for k in range(body[0]):
                for c in out.components:
                    if c.number == body[1 + 2 * k]:
                        c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            if body[0] != len(out.components):
                raise Unsupported("the scan holds only some of the components")
            out.scan = at
            return out
    raise Unsupported("no scan")


class _Bits:
    """Bits of one stretch of coded data between restart markers, stuffing removed."""

    def __init__(self, data: bytes):
        self.data, self.value, self.held, self.at = data + b"\0" * 8, 0, 0, 0
        self.end = 8 * len(data)
        self.read = 0

    def peek(self) -> int:
        while self.held < 16:
            self.value = (self.value << 8 | self.data[self.at]) if self.at < len(self.data) else self.value << 8
            self.at += 1
            self.held += 8
        return self.value >> (self.held - 16) & 0xFFFF

    def drop(self, n: int) -> None:
        self.held -= n
        self.read += n
        self.value &= (1 << self.held) - 1

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek() >> (16 - n)
        self.drop(n)
        return out if out >> (n - 1) else out - (1 << n) + 1  # values with a leading 0 are negative

    def symbol(self, table: np.ndarray) -> int:
        length, symbol = table[self.peek()].tolist()
        if not length or self.read > self.end:
            raise EOFError
        self.drop(length)
        return symbol


def _stretches(data: bytes) -> list[bytes]:
    """The coded data between restart markers, up to the first other marker."""
    out, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        kind = data[at + 1]
        if 0xD0 <= kind <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        elif kind not in (0x00, 0xFF):
            data = data[:at]
            break
        at += 2 if kind != 0xFF else 1
    out.append(data[start:])
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def luma_coefficients(data: bytes, most: int = BLOCKS) -> np.ndarray:
    """The quantized coefficients of the first component's blocks, n x 8 x 8, at most `most` of them."""
    head = header(data)
    if not head.baseline:
        raise Unsupported("progressive, lossless or of more than 8 bits")
    single = len(head.components) == 1
    widest, tallest = max(c.across for c in head.components), max(c.down for c in head.components)
    units = -(-head.width // (8 * widest)) * -(-head.height // (8 * tallest))
    if single:
        units = -(-head.width // 8) * -(-head.height // 8)
    blocks: list[np.ndarray] = []
    done = 0
    for stretch in _stretches(data[head.scan :]):
        bits, last = _Bits(stretch), [0] * len(head.components)
        left = min(units - done, head.restart or units)
        try:
            for _ in range(left):
                for k, c in enumerate(head.components):
                    for _ in range(1 if single else c.across * c.down):
                        block = np.zeros(64, dtype=np.int32)
                        last[k] += bits.take(bits.symbol(head.codes[(0, c.dc)]))
                        block[0] = last[k]
                        at = 1
                        while at < 64:
                            symbol = bits.symbol(head.codes[(1, c.ac)])
                            run, size = symbol >> 4, symbol & 15
                            if not size:
                                if run != 15:
                                    break
                                at += 16
                                continue
                            at += run
                            value = bits.take(size)
                            if at < 64:
                                block[ZIGZAG[at]] = value
                            at += 1
                        if k == 0:
                            blocks.append(block.reshape(8, 8))
                            if len(blocks) >= most:
                                return np.stack(blocks)
                done += 1
        except EOFError:
            break
    return np.stack(blocks) if blocks else np.zeros((0, 8, 8), dtype=np.int32)


def quantizer_mean(data: bytes) -> float | None:
    """The mean of the first table, null without one."""
    tables = header(data).quantizers
    return float(tables[min(tables)].mean()) if tables else None
