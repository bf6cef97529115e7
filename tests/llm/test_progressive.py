"""The decoder against progressive streams made here by the standard's rules: interleaved DC scans, EOB runs, refinements, restarts."""

import math
import struct

import numpy as np
import pytest

from waymark.llm import media

DC_SYMBOLS, AC_SYMBOLS = list(range(12)), [r << 4 | s for r in range(16) for s in range(8) if s < 7]


class Bits:
    """Codes of one length for each table: four bits for a DC symbol, nine for an AC symbol."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def dc(self, symbol):
        self.put(DC_SYMBOLS.index(symbol), 4)

    def ac(self, symbol):
        self.put(AC_SYMBOLS.index(symbol), 9)

    def number(self, value):
        n = abs(value).bit_length()
        self.put(value if value >= 0 else value + (1 << n) - 1, n)

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return bytes(sum(b << (7 - i) for i, b in enumerate(bits[at : at + 8])) for at in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


class Runs:
    """The end-of-block run of an AC scan, and the correction bits that go behind it."""

    def __init__(self, out):
        self.out, self.n, self.bits = out, 0, []

    def flush(self):
        if self.n:
            size = self.n.bit_length() - 1
            self.out.ac(size << 4)
            self.out.put(self.n - (1 << size), size)
            for b in self.bits:
                self.out.put(b, 1)
            self.n, self.bits = 0, []


def first_scan(out, run, block, low, high, al):
    zeros = 0
    for k in range(low, high + 1):
        v = int(math.copysign(abs(block[k]) >> al, block[k]))
        if not v:
            zeros += 1
            continue
        run.flush()
        while zeros > 15:
            out.ac(0xF0)
            zeros -= 16
        out.ac(zeros << 4 | abs(v).bit_length())
        out.number(v)
        zeros = 0
    run.n += zeros > 0


def refining_scan(out, run, block, low, high, al):
    size = [abs(v) >> al for v in block]
    fresh = [k for k in range(low, high + 1) if size[k] == 1]
    zeros, waiting = 0, []
    for k in range(low, high + 1):
        if not size[k]:
            zeros += 1
            continue
        while zeros > 15 and fresh and k <= fresh[-1]:
            run.flush()
            out.ac(0xF0)
            zeros -= 16
            for b in waiting:
                out.put(b, 1)
            waiting = []
        if size[k] > 1:
            waiting.append(size[k] & 1)
            continue
        run.flush()
        out.ac(zeros << 4 | 1)
        out.put(int(block[k] > 0), 1)
        for b in waiting:
            out.put(b, 1)
        zeros, waiting = 0, []
    if zeros or waiting:
        run.n += 1
        run.bits += waiting


def picture(width, height, parts, planes, restart):
    """parts: (h, v) of each component; planes: its blocks, row-major over whole units of the picture."""
    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    most_h, most_v = max(h for h, _ in parts), max(v for _, v in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    out = [b"\xff\xd8", seg(0xDB, b"\x00" + bytes(range(1, 65)))]
    out.append(seg(0xC2, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts))))
    out.append(seg(0xC4, bytes([0x00, 0, 0, 0, len(DC_SYMBOLS), *[0] * 12, *DC_SYMBOLS]) + bytes([0x10, *[0] * 8, len(AC_SYMBOLS), *[0] * 7, *AC_SYMBOLS])))
    if restart:
        out.append(seg(0xDD, struct.pack(">H", restart)))

    def scan(components, low, high, ah, al, units, code):
        out.append(seg(0xDA, bytes([len(components), *(x for i in components for x in (i + 1, 0)), low, high, ah << 4 | al])))
        step = restart or len(units)
        for n, begin in enumerate(range(0, len(units), step)):
            bits = Bits()
            run = Runs(bits)
            code(bits, run, units[begin : begin + step])
            run.flush()
            out.append((bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b"") + bits.done())

    every = [[(i, (y * v + b) * across * h + x * h + a) for i, (h, v) in enumerate(parts) for b in range(v) for a in range(h)] for y in range(down) for x in range(across)]
    if len(parts) == 1:
        own = -(-width // 8)
        every = [[(0, y * across * parts[0][0] + x)] for y in range(-(-height // 8)) for x in range(own)]

    def dc_first(bits, run, units):
        last = [0] * len(parts)
        for unit in units:
            for i, b in unit:
                v = int(planes[i][b][0]) >> 1
                bits.dc(abs(v - last[i]).bit_length())
                bits.number(v - last[i])
                last[i] = v

    scan(range(len(parts)), 0, 0, 0, 1, every, dc_first)
    alone = []
    for i, (h, v) in enumerate(parts):
        wide, high = -(-(-(-width * h // most_h)) // 8), -(-(-(-height * v // most_v)) // 8)
        alone.append([y * across * h + x for y in range(high) for x in range(wide)])
    for (ah, al), code in (((0, 1), first_scan), ((1, 0), refining_scan)):
        for i in range(len(parts)):
            for low, high in ((1, 5), (6, 63)):
                scan([i], low, high, ah, al, alone[i], lambda bits, run, units, i=i, low=low, high=high, al=al, code=code: [code(bits, run, planes[i][b], low, high, al) for b in units])
        if not ah:
            scan(range(len(parts)), 0, 0, 1, 0, every, lambda bits, run, units: [bits.put(int(planes[i][b][0]) & 1, 1) for unit in units for i, b in unit])
    return b"".join(out) + b"\xff\xd9", alone


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize(("width", "height", "parts"), [(40, 24, [(2, 2), (1, 1), (1, 1)]), (17, 33, [(2, 1), (1, 1), (1, 1)]), (20, 9, [(1, 1)]), (64, 48, [(1, 1), (1, 1), (1, 1)])])
def test_decodes_what_the_standard_allows(width, height, parts, restart):
    rng = np.random.default_rng(width * 10 + restart)
    most_h, most_v = max(h for h, _ in parts), max(v for _, v in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    planes = []
    for h, v in parts:
        blocks = rng.integers(-60, 61, (across * h * down * v, 64)) * (rng.random((across * h * down * v, 64)) < rng.choice([0.0, 0.02, 0.15, 0.6], (across * h * down * v, 1)))
        blocks[:, 0] = rng.integers(-500, 500, len(blocks))
        planes.append(blocks)
    data, alone = picture(width, height, parts, planes, restart)
    got = media.decode(data)
    assert (got.width, got.height, len(got.components)) == (width, height, len(parts))
    for c, blocks, inside in zip(got.components.values(), planes, alone, strict=True):
        assert (c.coefficients[inside] == blocks[inside]).all()
    rgb = media.rgb(got)
    assert rgb.shape == (height, width, 3)


def test_samples_equal_the_transform_by_its_definition():
    """One block of one component: the inverse transform as a double sum, quantised by the stream's table."""
    rng = np.random.default_rng(1)
    block = np.zeros((1, 64), int)
    block[0, :12] = rng.integers(-6, 7, 12)
    data, _ = picture(8, 8, [(1, 1)], [block], 0)
    order = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))
    scale = lambda k: math.sqrt(0.5) if k == 0 else 1.0
    got = media.rgb(media.decode(data))
    for y in range(8):
        for x in range(8):
            total = sum(scale(u) * scale(v) * block[0, i] * (i + 1) * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * v * math.pi / 16) for i, (u, v) in enumerate(order)) / 4
            assert abs(int(got[y, x, 0]) - min(255, max(0, total + 128))) <= 0.51 and len(set(got[y, x].tolist())) == 1
