"""Progressive JPEG: entropy-coded scans to coefficient arrays, and coefficient arrays to RGB tensors.

The decoder takes any progressive file of 8-bit samples with Huffman coding (one to four components; one is grey, three are
YCbCr): spectral selection and successive approximation, interleaved scans, restart intervals. Scans
whose bits lie at a fixed stride are read with numpy as a whole: bit planes of the DC, tables that hold a single symbol,
and the correction bits inside end-of-band runs. Everything else is read symbol by symbol.

The encoder stores bytes as coefficients, 64 a block, without loss. It chooses values so that first scans have one symbol (a
fixed stride): AC coefficients are 256 + byte, and DC coefficients alternate between 512 + byte and -byte, so that all
differences have one category.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np


def _kept(f):
    """f with its results of up to 256 arguments kept; unlike the library's cache it goes to executors by value."""
    known = {}

    def g(*x):
        if x not in known:
            if len(known) >= 256:
                known.clear()
            known[x] = f(*x)
        return known[x]

    return g


@_kept
def zigzag() -> np.ndarray:
    """Natural index of each zigzag position."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


@_kept
def inverse_transform() -> np.ndarray:
    """64 zigzag coefficients to 64 samples, as a matrix."""
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return np.kron(basis, basis)[zigzag()].astype(np.float32)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks in a row of a scan of this component alone
    high: int = 0
    stride: int = 0  # blocks in a row of the array, whole MCUs
    rows: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    parts: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols = symbols
        self.codes: dict[tuple[int, int], int] = {}
        code, k = 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.codes[(length, code)] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        #: length of the code of the only symbol, if there is but one
        self.only = next(iter(self.codes))[0] if len(self.codes) == 1 else 0


class Bits:
    """A cursor over the bits of one entropy-coded segment; behind its end come ones."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), dtype=np.uint8)
        self.bits = np.unpackbits(raw)
        self.at = 0

    def take(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        self.at += n
        return out if len(out) == n else np.concatenate([out, np.ones(n - len(out), np.uint8)])

    def number(self, n: int) -> int:
        x = 0
        for b in self.take(n).tolist():
            x = x << 1 | b
        return x

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | (int(self.bits[self.at]) if self.at < len(self.bits) else 1)
            self.at += 1
            if (s := table.codes.get((length, code))) is not None:
                return s
        raise ValueError("a code that no table has")


def _signed(x: int, size: int) -> int:
    return x if not size or x >> (size - 1) else x - (1 << size) + 1


def _values(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as numbers."""
    return bits.astype(np.int32) @ (1 << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int32))


def _signed_values(bits: np.ndarray) -> np.ndarray:
    v, size = _values(bits), bits.shape[1]
    return np.where(bits[:, 0] == 1, v, v - (1 << size) + 1) if size else np.zeros(len(bits), np.int32)


@_kept
def _order(shape: tuple[tuple[int, int, int, int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(component, block) in the order of a scan. shape: h, v, wide, high, stride of each component."""
    if len(shape) == 1:
        _, _, wide, high, stride = shape[0]
        return np.zeros(wide * high, np.int64), (np.arange(high)[:, None] * stride + np.arange(wide)[None, :]).reshape(-1)
    across, down = shape[0][4] // shape[0][0], -(-shape[0][3] // shape[0][1])
    comp, block = [], []
    for i, (h, v, _, _, stride) in enumerate(shape):
        y = np.arange(down)[:, None, None, None] * v + np.arange(v)[None, None, :, None]
        x = np.arange(across)[None, :, None, None] * h + np.arange(h)[None, None, None, :]
        b = (y * stride + x).reshape(down * across, h * v)
        block.append(b)
        comp.append(np.full(b.shape, i))
    return np.concatenate(comp, axis=1).reshape(-1), np.concatenate(block, axis=1).reshape(-1)


def _dc_first(bits: Bits, coef, comp, block, tables, low: int) -> None:
    only = {i: (t.only, t.symbols[0]) for i, t in tables.items()}
    if all(length for length, _ in only.values()) and len(set(only.values())) == 1:
        length, size = only[0]
        diff = _signed_values(bits.take(len(comp) * (length + size)).reshape(len(comp), -1)[:, length:])
    else:
        diff = np.zeros(len(comp), np.int64)
        for k, i in enumerate(comp.tolist()):
            size = bits.symbol(tables[i])
            diff[k] = _signed(bits.number(size), size)
    for i in tables:
        own = comp == i
        coef[i][block[own], 0] = np.cumsum(diff[own]) << low


def _dc_more(bits: Bits, coef, comp, block, low: int) -> None:
    plane = bits.take(len(comp)).astype(np.int32) << low
    for i in range(len(coef)):
        own = comp == i
        coef[i][block[own], 0] |= plane[own]


def _ac_first(bits: Bits, coef: np.ndarray, block: np.ndarray, table: Huffman, start: int, end: int, low: int) -> None:
    n = end - start + 1
    if table.only and not table.symbols[0] >> 4 and table.symbols[0]:
        size = table.symbols[0]
        v = bits.take(len(block) * n * (table.only + size)).reshape(len(block) * n, -1)[:, table.only :]
        coef[block, start : end + 1] = (_signed_values(v) << low).reshape(len(block), n)
        return
    run = 0
    for b in block.tolist():
        if run:
            run -= 1
            continue
        k = start
        while k <= end:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                coef[b, k] = _signed(bits.number(size), size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.number(zeros) - 1
                break


def _ac_more(bits: Bits, coef: np.ndarray, block: np.ndarray, table: Huffman, start: int, end: int, low: int) -> None:
    bit = 1 << low

    def correct(rows: np.ndarray, k: int) -> None:
        """One bit for each coefficient of the rows, from k on, that is not 0."""
        band = coef[rows, k : end + 1]
        known = band != 0
        up = bits.take(int(known.sum())).astype(bool)
        fresh = band[known]
        band[known] = np.where(up & (np.abs(fresh) & bit == 0), fresh + np.sign(fresh) * bit, fresh)
        coef[rows, k : end + 1] = band

    at = 0
    while at < len(block):
        b, k = int(block[at]), start
        run = 0
        while k <= end:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.number(zeros)
                break
            new = (1 if bits.number(1) else -1) * bit if size else 0
            while k <= end:
                if coef[b, k]:
                    if bits.number(1) and not abs(int(coef[b, k])) & bit:
                        coef[b, k] += bit if coef[b, k] > 0 else -bit
                elif zeros:
                    zeros -= 1
                else:
                    coef[b, k] = new
                    k += 1
                    break
                k += 1
        if run:
            if k > start:
                correct(block[at : at + 1], k)
                at, run, k = at + 1, run - 1, start
            if run:
                correct(block[at : at + run], start)
                at += run
        else:
            at += 1


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def decode(data: bytes) -> Image:
    """The image with its coefficients, in zigzag order."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    im, tables, interval, at = Image(), {}, 0, 2
    while at < len(data):
        kind = data[at + 1]
        if kind == 0xD9:
            return im
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                im.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xFE:
            im.comments.append(body)
        elif kind == 0xC2:
            im.height, im.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            im.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            ht, vt = max(c.h for c in im.parts), max(c.v for c in im.parts)
            for c in im.parts:
                c.wide, c.high = -(-(-(-im.width * c.h // ht)) // 8), -(-(-(-im.height * c.v // vt)) // 8)
                c.stride, c.rows = -(-im.width // (8 * ht)) * c.h, -(-im.height // (8 * vt)) * c.v
                c.coef = np.zeros((c.stride * c.rows, 64), np.int32)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("no progressive JPEG with Huffman coding")
        elif kind == 0xDA:
            end = _MARKER.search(data, at)
            stop = end.start() if end else len(data)
            _scan(im, body, tables, interval, data[at:stop])
            at = stop
    return im


def _scan(im: Image, body: bytes, tables: dict, interval: int, data: bytes) -> None:
    n = body[0]
    parts = [next(c for c in im.parts if c.ident == body[1 + 2 * i]) for i in range(n)]
    used = [body[2 + 2 * i] for i in range(n)]
    start, end, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    comp, block = _order(tuple((c.h, c.v, c.wide, c.high, c.stride) for c in parts))
    step = interval * (1 if n == 1 else sum(c.h * c.v for c in parts)) or len(comp)
    pieces = _RESTART.split(data) if interval else [data]
    for k, piece in enumerate(pieces):
        bits, c, b = Bits(piece), comp[k * step : (k + 1) * step], block[k * step : (k + 1) * step]
        if not start and not high:
            _dc_first(bits, [p.coef for p in parts], c, b, {i: tables[u >> 4] for i, u in enumerate(used)}, low)
        elif not start:
            _dc_more(bits, [p.coef for p in parts], c, b, low)
        else:
            (_ac_more if high else _ac_first)(bits, parts[0].coef, b, tables[0x10 | used[0] & 15], start, end, low)


def rgb(im: Image) -> np.ndarray:
    """Height x width x 3, 8-bit: inverse transform, chroma repeated to full resolution, YCbCr to RGB."""
    ht, vt = max(c.h for c in im.parts), max(c.v for c in im.parts)
    planes = []
    for c in im.parts:
        x = (c.coef.astype(np.float32) * im.quant[c.table]) @ inverse_transform()
        x = np.clip(np.rint(x + np.float32(128)), 0, 255).reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)
        planes.append(np.repeat(np.repeat(x, vt // c.v, axis=0), ht // c.h, axis=1)[: im.height, : im.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
    out = np.empty((im.height, im.width, 3), np.uint8)
    out[:, :, 0] = np.clip(np.rint(y + np.float32(1.402) * cr), 0, 255)
    out[:, :, 1] = np.clip(np.rint(y - np.float32(0.344136) * cb - np.float32(0.714136) * cr), 0, 255)
    out[:, :, 2] = np.clip(np.rint(y + np.float32(1.772) * cb), 0, 255)
    return out


def _stuffed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits).tobytes().replace(b"\xff", b"\xff\x00")


def _numbers(v: np.ndarray, size: int) -> np.ndarray:
    """Numbers under 65536 as rows of ``size`` bits."""
    return np.unpackbits(v.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - size :]


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


#: Symbols of the four tables. DC: category 9. AC: no zeros before a value of category 8. Third: ends of band.
_DC, _AC, _ENDS = 0x09, 0x08, bytes(k << 4 for k in range(15))
_MARK = b"payload "


def grid(blocks: int) -> tuple[int, int]:
    """MCUs across and down: each holds four blocks of luma and one of each chroma."""
    n = max(1, -(-blocks // 6))
    across = n if n <= 32 else int(np.ceil(np.sqrt(n)))
    return across, -(-n // across)


@_kept
def _dc_signs(across: int, down: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    shape = ((2, 2, 2 * across, 2 * down, 2 * across), (1, 1, across, down, across), (1, 1, across, down, across))
    comp, block = _order(shape)
    even = []
    for i in range(3):
        b = block[comp == i]
        e = np.zeros(len(b), bool)
        e[b] = np.arange(len(b)) % 2 == 0
        even.append(e)
    return comp, block, even


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 file that holds the payload (a positive multiple of 64 bytes) as coefficients."""
    blocks = len(payload) // 64
    across, down = grid(blocks)
    n = across * down
    raw = np.zeros((6 * n, 64), np.int32)
    raw[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    parts = [raw[: 4 * n], raw[4 * n : 5 * n], raw[5 * n :]]
    comp, block, even = _dc_signs(across, down)
    head = [
        b"\xff\xd8",
        _segment(0xFE, _MARK + len(payload).to_bytes(8, "big")),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC2, b"\x08" + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"),
        _segment(0xC4, b"\x00" + b"\1" + bytes(15) + bytes([_DC]) + b"\x10" + b"\1" + bytes(15) + bytes([_AC]) + b"\x11" + bytes(3) + b"\x0f" + bytes(12) + _ENDS),
    ]

    def scan(which: list[tuple[int, int]], start: int, end: int, high: int, low: int, bits: np.ndarray) -> None:
        spec = bytes([len(which)]) + b"".join(bytes([i + 1, t]) for i, t in which) + bytes([start, end, high << 4 | low])
        head.append(_segment(0xDA, spec))
        head.append(_stuffed(bits))

    dc = [np.where(e, 512 + p[:, 0], -p[:, 0]) for p, e in zip(parts, even)]
    every = np.zeros(len(comp), np.int32)
    diff = np.zeros(len(comp), np.int32)
    for i in range(3):
        own = comp == i
        every[own] = dc[i][block[own]]
        diff[own] = np.diff(every[own] >> 1, prepend=0)
    coded = np.where(diff > 0, diff, diff + (1 << _DC) - 1)
    scan([(0, 0), (1, 0), (2, 0)], 0, 0, 0, 1, np.hstack([np.zeros((len(comp), 1), np.uint8), _numbers(coded, _DC)]).reshape(-1))
    for start, end in ((1, 5), (6, 63)):
        for i, p in enumerate(parts):
            v = (128 | p[:, start : end + 1] >> 1).astype(np.uint8).reshape(-1, 1)
            scan([(i, 0)], start, end, 0, 1, np.hstack([np.zeros((len(v), 1), np.uint8), np.unpackbits(v, axis=1)]).reshape(-1))
    scan([(0, 0), (1, 0), (2, 0)], 0, 0, 1, 0, (every & 1).astype(np.uint8))
    for i, p in enumerate(parts):
        bits, at = [], 0
        while at < len(p):
            run = min(len(p) - at, 32767)
            k = run.bit_length() - 1
            bits += [_numbers(np.array([k]), 4)[0], _numbers(np.array([run - (1 << k)]), k)[0] if k else np.zeros(0, np.uint8), (p[at : at + run, 1:] & 1).astype(np.uint8).reshape(-1)]
            at += run
        scan([(i, 1)], 1, 63, 1, 0, np.concatenate(bits))
    return b"".join(head) + b"\xff\xd9"


def payload(im: Image) -> bytes:
    """What ``encode`` has stored."""
    size = next(int.from_bytes(c[len(_MARK) :], "big") for c in im.comments if c.startswith(_MARK))
    rows = []
    for c in im.parts:
        x = c.coef - 256
        x[:, 0] = np.where(c.coef[:, 0] > 0, c.coef[:, 0] - 512, -c.coef[:, 0])
        x[c.coef[:, 0] == 512, 0] = 0
        rows.append(x)
    return np.concatenate(rows).astype(np.uint8).tobytes()[:size]
