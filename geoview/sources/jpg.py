"""Baseline JPEG files as pixels.

A file is cut into its segments; the scan's bits are read by tables of 16-bit
prefixes, one symbol a step, into coefficients, and all that follows (scale, inverse
transform, upsampling, colours) is done on whole planes by numpy.  So the cost of an
image is a step of Python for each coefficient that is not 0.  Sequential files of
8 bits with Huffman codes are read, of one or three components with any sampling
factors, with restart intervals; progressive and arithmetic files raise an error.
"""

from __future__ import annotations

import struct

import numpy as np


def _zigzag() -> np.ndarray:
    """Place in row order of the coefficient at each place of a scan: diagonals in
    turn, each second one upwards."""
    cells = sorted(((x + y, y if (x + y) % 2 else x, x, y) for x in range(8) for y in range(8)))
    return np.array([y * 8 + x for *_, x, y in cells])


ZIGZAG = _zigzag()
#: Rows of the orthonormal cosine transform of eight samples.
COSINES = np.array([[(0.125 if k == 0 else 0.25) ** 0.5 * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


class _Codes:
    """A Huffman table: length and symbol by the next 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.size, self.symbol = [0] * 65536, [0] * 65536
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                lo = code << (16 - length)
                span = 1 << (16 - length)
                self.size[lo : lo + span] = [length] * span
                self.symbol[lo : lo + span] = [symbols[at]] * span
                code, at = code + 1, at + 1
            code <<= 1


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + bytes(8), 0, len(data) * 8

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 5], "big") >> (40 - n - (self.at & 7))) & ((1 << n) - 1)

    def symbol(self, codes: _Codes) -> int:
        bits = self.peek(16)
        size = codes.size[bits]
        if not size or self.at > self.end:
            raise ValueError("the scan ends early or has no such code")
        self.at += size
        return codes.symbol[bits]

    def number(self, size: int) -> int:
        """A value of ``size`` bits, of which a first bit of 0 makes it negative."""
        if not size:
            return 0
        v = self.peek(size)
        self.at += size
        return v if v >> (size - 1) else v - (1 << size) + 1


def _segments(data: bytes):
    """(marker, content) up to the scan, whose entropy-coded bytes follow its head."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDA:
            yield 0, data[at:]
            return


def _intervals(scan: bytes) -> list[bytes]:
    """The scan's bytes between restart markers, without stuffed zeros."""
    out, part, at = [], bytearray(), 0
    while at < len(scan):
        next_ = scan.find(b"\xff", at)
        if next_ < 0 or next_ + 1 >= len(scan):
            part += scan[at:]
            break
        part += scan[at:next_]
        kind = scan[next_ + 1]
        if kind == 0:
            part.append(0xFF)
        elif 0xD0 <= kind <= 0xD7:
            out.append(bytes(part))
            part = bytearray()
        elif kind != 0xFF:
            break
        at = next_ + (1 if kind == 0xFF else 2)
    return [*out, bytes(part)]


def _doubled(plane: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many samples along an axis, at quarter steps between neighbours."""
    p = np.moveaxis(plane, axis, 0)
    before, behind = np.concatenate([p[:1], p[:-1]]), np.concatenate([p[1:], p[-1:]])
    out = np.stack([(3 * p + before) / 4, (3 * p + behind) / 4], 1).reshape(-1, *p.shape[1:])
    return np.moveaxis(out, 0, axis)


def decode(data: bytes) -> np.ndarray:
    """Height x width x 4, as red, green, blue and alpha, which is 255."""
    scales, codes, parts, every, order, scan = {}, {}, [], 0, [], None
    width = height = 0
    for marker, body in _segments(data):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide = body[at] >> 4
                values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1)
                scales[body[at] & 15] = values.astype(float)
                at += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            at = 0
            while at < len(body):
                counts = body[at + 1 : at + 17]
                n = sum(counts)
                codes[body[at]] = _Codes(counts, body[at + 17 : at + 17 + n])
                at += 17 + n
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3) or not width or not height:
                raise ValueError(f"{depth} bits, {n} components, {width} x {height}")
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"frames of kind {marker:#x} are not read")
        elif marker == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            order = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
        elif marker == 0:
            scan = body
    if not parts or scan is None or [c for c, _ in order] != [p[0] for p in parts]:
        raise ValueError("no frame, no scan, or a scan of some components")
    if len(parts) == 1:
        parts[0][1] = parts[0][2] = 1  # one component has no larger units
    hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    blocks = [np.zeros((down * v, across * h, 64)) for _, h, v, _ in parts]
    tables = [(codes[t >> 4], codes[16 + (t & 15)]) for _, t in order]
    intervals = _intervals(scan)
    bits, last = _Bits(intervals[0]), [0] * len(parts)
    for unit in range(across * down):
        if every and unit and unit % every == 0:
            bits, last = _Bits(intervals[unit // every]), [0] * len(parts)
        y0, x0 = divmod(unit, across)
        for c, (_, h, v, _) in enumerate(parts):
            dc, ac = tables[c]
            for y in range(v):
                for x in range(h):
                    out = blocks[c][y0 * v + y, x0 * h + x]
                    last[c] += bits.number(bits.symbol(dc))
                    out[0] = last[c]
                    k = 1
                    while k < 64:
                        run, size = divmod(bits.symbol(ac), 16)
                        if not size:
                            if run < 15:
                                break
                            k += 16
                            continue
                        k += run
                        if k > 63:
                            raise ValueError("a block has too many coefficients")
                        out[ZIGZAG[k]] = bits.number(size)
                        k += 1
    planes = []
    for (_, h, v, q), b in zip(parts, blocks):
        scale = np.empty(64)
        scale[ZIGZAG] = scales[q]
        px = COSINES.T @ (b * scale).reshape(*b.shape[:2], 8, 8) @ COSINES
        plane = np.clip(np.round(px.transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, -1) + 128), 0, 255)
        plane = plane[: -(-height * v // vm), : -(-width * h // hm)]
        for axis, factor in ((1, hm / h), (0, vm / v)):
            plane = _doubled(plane, axis) if factor == 2 else np.repeat(plane, -(-int(factor * 4) // 4), axis)
        planes.append(plane[:height, :width])
    out = np.full((height, width, 4), 255, np.uint8)
    if len(planes) == 1:
        out[:, :, :3] = planes[0][:, :, None]
        return out
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    out[:, :, :3] = np.clip(np.round(rgb), 0, 255)
    return out
