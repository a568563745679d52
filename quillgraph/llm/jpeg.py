"""Progressive JPEG in numpy: coefficient arrays to scans, and scans to coefficient arrays and RGB tensors.

The decoder accumulates spectral-selection and successive-approximation scans (Huffman coding, any sampling,
restart intervals) as ITU T.81 annex G describes. Runs of equal symbols, end-of-band runs and DC differences are
read many at a time; everything else symbol by symbol.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np


def _zigzag() -> np.ndarray:
    """Raster position of each zigzag position."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    return np.array([8 * y + x for y, x in sorted(cells, key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))])


ZIGZAG = _zigzag()
_n = np.arange(8)
_DCT = np.sqrt(np.where(_n == 0, 1, 2) / 8)[:, None] * np.cos((2 * _n[None, :] + 1) * _n[:, None] * np.pi / 16)
#: Zigzag coefficients to samples in raster order.
_INVERSE = np.kron(_DCT, _DCT)[ZIGZAG].astype(np.float32)


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    across: int = 0
    down: int = 0
    stride: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    quantization: dict[int, np.ndarray]
    comments: list[bytes] = field(default_factory=list)


class Huffman:
    """A table of code lengths: symbols in order of their codes, counts by length."""

    def __init__(self, counts: list[int], symbols: bytes):
        self.counts, self.symbols = counts, symbols
        self.code: dict[int, tuple[int, int]] = {}
        look = np.zeros(1 << 16, np.int32)  # length << 8 | symbol; 0: no code
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                self.code[s] = (code, length)
                look[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | s
                code += 1
            at += n
            code <<= 1
        self.look = look
        self._list: list[int] | None = None

    @property
    def listed(self) -> list[int]:
        if self._list is None:
            self._list = self.look.tolist()
        return self._list


_tables: dict[bytes, Huffman] = {}


def _huffman(raw: bytes) -> Huffman:
    """Tables repeat from image to image, so a few are kept."""
    if raw not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[raw] = Huffman(list(raw[:16]), raw[16:])
    return _tables[raw]


# -- writing ---------------------------------------------------------------------------------------------------------


def _bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """The low bits of each value one after another, filled up with ones, with stuffed zero bytes."""
    total = int(lengths.sum())
    at = np.repeat(np.cumsum(lengths) - 1, lengths) - np.arange(total)
    bits = (np.repeat(values, lengths) >> at) & 1
    return _stuffed(np.packbits(np.concatenate((bits, np.ones(-total % 8, bits.dtype))).astype(np.uint8)).tobytes())


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(components: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in c), first, last, high << 4 | low])) + data


#: DC categories in four bits, the one AC symbol of a first pass in one, end-of-band runs in four.
_DC = bytes([0, 0, 0, 9, *[0] * 12, *range(9)])
_AC_FIRST = bytes([1, *[0] * 15, 0x07])
_AC_REFINE = bytes([0, 0, 0, 15, *[0] * 12, *(16 * n for n in range(15))])


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients hold ``payload`` (a positive multiple of 64 bytes) without loss.

    The byte b is the coefficient b if b > 127, else b - 255: magnitudes 128 to 255, so every coefficient has eight
    bits, and JPEG's own extra bits of a coefficient are the byte. Blocks fill the luma plane, then both chroma
    planes. Scans: DC without its last bit; coefficients 1 to 5 and 6 to 63 of each component without their last
    bit; the last bits of each component; the last bits of DC.
    """
    blocks = len(payload) // 64
    units = -(-blocks // 6)
    across = min(4095, int(np.ceil(np.sqrt(units))))
    down = -(-units // across)
    if not blocks or len(payload) % 64 or down > 4095:
        raise ValueError("the payload must be 64 to 6 * 64 * 4095**2 bytes, a multiple of 64")
    data = np.zeros((6 * across * down, 64), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    value = np.where(data > 127, data.astype(np.int16), data.astype(np.int16) - 255)
    n = across * down
    planes = [value[: 4 * n], value[4 * n : 5 * n], value[5 * n :]]
    ids, sampling = (1, 2, 3), (0x22, 0x11, 0x11)
    out = [b"\xff\xd8", _segment(0xFE, b"payload_bytes=%d" % len(payload)), _segment(0xDB, bytes([0]) + bytes([1] * 64))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes(x for i, s in zip(ids, sampling, strict=True) for x in (i, s, 0))))
    out.append(_segment(0xC4, bytes([0x00]) + _DC + bytes([0x10]) + _AC_FIRST + bytes([0x11]) + _AC_REFINE))
    dc = _interleaved([p[:, 0] for p in planes], across, down)
    low = dc >> 1
    diff = low.copy()
    for members in ([0, 1, 2, 3], [4], [5]):
        of = low[:, members].reshape(-1)
        diff[:, members] = np.diff(of, prepend=of.dtype.type(0)).reshape(-1, len(members))
    diff = diff.reshape(-1).astype(np.int64)
    category = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << category) - 1, diff)
    out.append(_scan([(i, 0x00) for i in ids], 0, 0, 0, 1, _bits(category << category | extra, category + 4)))
    for i, plane in zip(ids, planes, strict=True):
        half = np.sign(plane) * (np.abs(plane) >> 1)
        seven = np.where(half < 0, half + 127, half).astype(np.uint8)  # after the code 0: one byte a coefficient
        for a, b in ((1, 5), (6, 63)):
            out.append(_scan([(i, 0x00)], a, b, 0, 1, _stuffed(seven[:, a : b + 1].tobytes())))
    for i, plane in zip(ids, planes, strict=True):
        last = (np.abs(plane[:, 1:]) & 1).astype(np.uint8)
        bits = []
        for at in range(0, len(plane), 32767):
            run = min(32767, len(plane) - at)
            n_bits = run.bit_length() - 1
            bits.append(np.array([int(x) for x in f"{n_bits:04b}"] + [int(x) for x in f"{run:b}"[1:]], np.uint8))
            bits.append(last[at : at + run].reshape(-1))
        whole = np.concatenate(bits)
        out.append(_scan([(i, 0x01)], 1, 63, 1, 0, _stuffed(np.packbits(np.concatenate((whole, np.ones(-len(whole) % 8, np.uint8)))).tobytes())))
    whole = (dc & 1).reshape(-1).astype(np.uint8)
    out.append(_scan([(i, 0x00) for i in ids], 0, 0, 1, 0, _stuffed(np.packbits(np.concatenate((whole, np.ones(-len(whole) % 8, np.uint8)))).tobytes())))
    return b"".join(out) + b"\xff\xd9"


def _interleaved(planes: list[np.ndarray], across: int, down: int) -> np.ndarray:
    """[unit, 6]: a 4:2:0 image's blocks in the order of interleaved scans."""
    luma = planes[0].reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    return np.concatenate((luma, planes[1][:, None], planes[2][:, None]), axis=1)


def payload_of(frame: Frame) -> bytes:
    size = int(next(c for c in frame.comments if c.startswith(b"payload_bytes="))[14:])
    value = np.concatenate([c.coefficients for c in frame.components])
    return np.where(value < 0, value + 255, value).astype(np.uint8).tobytes()[:size]


# -- reading ---------------------------------------------------------------------------------------------------------


class _Reader:
    """Bits of one entropy-coded segment, without stuffed bytes, followed by ones."""

    def __init__(self, data: bytes):
        self.raw = data + b"\xff" * 8
        self.data = np.frombuffer(self.raw, np.uint8)
        self.bits = 8 * len(data)
        self.at = 0

    def peek16(self) -> int:
        p = self.at >> 3
        return int.from_bytes(self.raw[p : p + 3]) >> (8 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        p, self.at = self.at, self.at + n
        return int.from_bytes(self.raw[p >> 3 : (p >> 3) + 4]) >> (32 - (p & 7) - n) & ((1 << n) - 1) if n else 0

    def symbol(self, table: Huffman) -> int:
        found = table.listed[self.peek16()]
        if not found or self.at >= self.bits:
            raise ValueError("broken entropy-coded data")
        self.at += found >> 8
        return found & 0xFF

    def strided(self, width: int, n: int) -> np.ndarray:
        """The next n groups of ``width`` bits (32 at most), without moving on."""
        if width == 8 and not self.at & 7:
            return self.data[self.at >> 3 : (self.at >> 3) + n].astype(np.int64)
        p = self.at + width * np.arange(n)
        byte = p >> 3
        word = np.zeros(n, np.int64)
        for k in range(5):
            word = word << 8 | self.data[np.minimum(byte + k, len(self.data) - 1)]
        return (word >> (40 - (p & 7) - width)) & ((1 << width) - 1)

    def bit_run(self, n: int) -> np.ndarray:
        a = self.at >> 3
        bits = np.unpackbits(self.data[a : (self.at + n + 7) // 8])[self.at & 7 :][:n]
        self.at += n
        return bits


def _extend(value: int, size: int) -> int:
    return value if value >> (size - 1) else value - (1 << size) + 1


def decode(data: bytes) -> Frame:
    """Accumulate all scans of a progressive JPEG into coefficient arrays (zigzag order)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, interval = 2, 0
    frame: Frame | None = None
    quantization: dict[int, np.ndarray] = {}
    huffman: dict[int, Huffman] = {}
    comments: list[bytes] = []
    while True:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comments.append(body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                raw = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                quantization[body[0] & 15] = raw.astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huffman[body[0]] = _huffman(body[1:n])
                body = body[n:]
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            frame = Frame(width, height, parts, quantization, comments)
            h, v = max(c.h for c in parts), max(c.v for c in parts)
            units = (-(-width // (8 * h)), -(-height // (8 * v)))
            for c in parts:
                c.across, c.down = -(-(-(-width * c.h // h)) // 8), -(-(-(-height * c.v // v)) // 8)
                c.stride = units[0] * c.h
                c.coefficients = np.zeros((c.stride * units[1] * c.v, 64), np.int32)
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("scan before frame")
            end = at
            while data[end] != 0xFF or data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end = data.index(b"\xff", end + 1 if data[end] == 0xFF else end)
            _decode_scan(frame, body, huffman, interval, _segments(data[at:end], interval))
            at = end
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive Huffman JPEG is decoded")
    if frame is None:
        raise ValueError("no frame")
    return frame


def _segments(data: bytes, interval: int) -> list[bytes]:
    parts, begin, at = [], 0, 0
    while interval and (at := data.find(b"\xff", at)) >= 0:
        if 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[begin:at])
            begin = at + 2
        at += 2
    return [x.replace(b"\xff\x00", b"\xff") for x in (*parts, data[begin:])]


@lru_cache(maxsize=512)
def _blocks(down: int, across: int, stride: int, v: int, h: int) -> np.ndarray:
    """[unit, block of it]: a component's blocks in the order of a scan."""
    y = (np.arange(down)[:, None, None, None] * v + np.arange(v)[:, None]) * stride
    x = np.arange(across)[:, None, None] * h + np.arange(h)
    return (y + x).reshape(-1, v * h)


def _decode_scan(frame: Frame, body: bytes, huffman: dict[int, Huffman], interval: int, segments: list[bytes]) -> None:
    n = body[0]
    by_id = {c.id: c for c in frame.components}
    members = [(by_id[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if n == 1:
        order = [(c, _blocks(c.down, c.across, c.stride, 1, 1)) for c, _ in members]
    else:
        order = [(c, _blocks(len(c.coefficients) // c.stride // c.v, c.stride // c.h, c.stride, c.v, c.h)) for c, _ in members]
    units = len(order[0][1])
    step = interval or units
    for k, data in enumerate(segments):
        reader = _Reader(data)
        part = [(c, where[k * step : (k + 1) * step]) for c, where in order]
        if not len(part[0][1]):
            break
        if first == 0 and not high:
            _dc_first(reader, part, [huffman[t >> 4] for _, t in members], low)
        elif first == 0:
            _dc_refine(reader, part, low)
        else:
            table = huffman[16 | members[0][1] & 15]
            (_ac_refine if high else _ac_first)(reader, part[0][0].coefficients, part[0][1][:, 0], table, first, last, low)


def _dc_first(reader: _Reader, part: list[tuple[Component, np.ndarray]], tables: list[Huffman], low: int) -> None:
    """All bit positions are looked up at once; a walk from code to code then finds those that begin one."""
    p = np.arange(reader.bits)
    word = reader.data.astype(np.int64)
    window = ((word[p >> 3] << 16 | word[(p >> 3) + 1] << 8 | word[(p >> 3) + 2]) >> (8 - (p & 7))) & 0xFFFF
    steps = {}
    for t in tables:
        if id(t) not in steps:
            found = t.look[window]
            steps[id(t)] = np.where(found > 0, p + (found >> 8) + (found & 0xFF), -1).tolist()
    pattern = [steps[id(t)] for (_, where), t in zip(part, tables, strict=True) for _ in range(where.shape[1])]
    units = len(part[0][1])
    begins, at = [], 0
    try:
        if len({id(x) for x in pattern}) == 1:
            step = pattern[0]
            for _ in range(units * len(pattern)):
                begins.append(at)
                at = step[at]
        else:
            for _ in range(units):
                for step in pattern:
                    begins.append(at)
                    at = step[at]
    except IndexError:
        raise ValueError("broken entropy-coded data") from None
    begin = np.array(begins).reshape(units, -1)
    if begin.min() < 0 or at < 0:
        raise ValueError("broken entropy-coded data")
    reader.at = at
    k = 0
    for (c, where), t in zip(part, tables, strict=True):
        own = begin[:, k : k + where.shape[1]].reshape(-1)
        k += where.shape[1]
        found = t.look[window[own]]
        size = (found & 0xFF).astype(np.int64)
        at = own + (found >> 8)
        wide = np.zeros(len(own), np.int64)
        for j in range(4):
            wide = wide << 8 | word[(at >> 3) + j]
        extra = (wide >> (32 - (at & 7) - size)) & ((1 << size) - 1)
        diff = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        c.coefficients[where.reshape(-1), 0] = np.cumsum(diff) << low


def _dc_refine(reader: _Reader, part: list[tuple[Component, np.ndarray]], low: int) -> None:
    each = [where.shape[1] for _, where in part]
    bits = reader.bit_run(len(part[0][1]) * sum(each)).reshape(-1, sum(each)).astype(np.int32)
    at = 0
    for (c, where), n in zip(part, each, strict=True):
        c.coefficients[where.reshape(-1), 0] |= bits[:, at : at + n].reshape(-1) << low
        at += n


def _ac_first(reader: _Reader, out: np.ndarray, where: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
    band = last - first + 1
    block, blocks = 0, len(where)
    while block < blocks:
        found = table.listed[reader.peek16()]
        length, size = found >> 8, found & 0xFF
        if 0 < size < 16 and length + size <= 32:  # a coefficient without zeros before it: perhaps one of many
            width, n = length + size, (blocks - block) * band
            n = min(n, (reader.bits - reader.at) // width)
            code = table.code[size][0]
            some = reader.strided(width, min(n, 4 * band))
            if len(some) >= band and (some[:band] >> size == code).all():
                if len(some) < n and (some >> size == code).all():
                    some = reader.strided(width, n)
                other = some >> size != code
                whole = (int(np.argmax(other)) if other.any() else len(some)) // band
                extra = some[: whole * band] & ((1 << size) - 1)
                value = np.where(extra >> (size - 1), extra, extra - (1 << size) + 1)
                rows = where[block : block + whole]
                if len(rows) and rows[-1] - rows[0] == len(rows) - 1:
                    out[rows[0] : rows[-1] + 1, first : last + 1] = (value << low).reshape(whole, band)
                else:
                    out[rows, first : last + 1] = (value << low).reshape(whole, band)
                reader.at += whole * band * width
                block += whole
                continue
        k, row = first, out[where[block]]
        while k <= last:
            s = reader.symbol(table)
            run, size = s >> 4, s & 15
            if size:
                k += run
                row[k] = _extend(reader.take(size), size) << low
                k += 1
            elif run == 15:
                k += 16
            else:  # end of band, for this and the following blocks
                block += (1 << run) + reader.take(run) - 1
                break
        block += 1


def _ac_refine(reader: _Reader, out: np.ndarray, where: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
    block, blocks = 0, len(where)

    def correct(rows: np.ndarray, k: int) -> None:
        """A bit for each coefficient from k on that is not zero."""
        cells = out[rows, k : last + 1]
        there = cells != 0
        bits = reader.bit_run(int(there.sum())).astype(np.int32)
        cells[there] += np.sign(cells[there]) * (bits << low)
        out[rows, k : last + 1] = cells

    while block < blocks:
        k, row = first, out[where[block]]
        while k <= last:
            s = reader.symbol(table)
            run, size = s >> 4, s & 15
            if not size and run < 15:
                total = (1 << run) + reader.take(run)
                correct(where[block : block + 1], k)
                if total > 1:
                    correct(where[block + 1 : block + total], first)
                block += total - 1
                break
            new = (1 if reader.take(1) else -1) << low if size else 0
            while k <= last:
                if row[k]:
                    if reader.take(1):
                        row[k] += (1 << low) if row[k] > 0 else -(1 << low)
                elif run:
                    run -= 1
                else:
                    row[k] = new
                    k += 1
                    break
                k += 1
        block += 1


def rgb(frame: Frame) -> np.ndarray:
    """The full-resolution tensor [height, width, 3], uint8: inverse transform, chroma upsampled by repetition."""
    h, v = max(c.h for c in frame.components), max(c.v for c in frame.components)
    planes = []
    for c in frame.components:
        samples = (c.coefficients * frame.quantization[c.table]).astype(np.float32) @ _INVERSE + 128
        rows = len(c.coefficients) // c.stride
        plane = samples.reshape(rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * c.stride)
        if h // c.h > 1:
            plane = np.repeat(plane, h // c.h, axis=1)
        if v // c.v > 1:
            plane = np.repeat(plane, v // c.v, axis=0)
        planes.append(np.clip(plane[: frame.height, : frame.width], 0, 255))
    if len(planes) == 1:
        out = np.repeat(planes[0][:, :, None], 3, axis=2)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=2)
    return (np.clip(out, 0, 255) + 0.5).astype(np.uint8)
