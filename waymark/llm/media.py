"""Media columns: text payloads stored as progressive JPEG coefficients, and their full-resolution RGB tensors.

A payload byte is one quantised DCT coefficient (the format's unit): 64 bytes a block, 4:2:0, four luma blocks and one of
each chroma in a unit of 16 x 16 pixels. Each component has six scans: DC with its low bit left out, coefficients 1-5
and 6-63 with theirs left out, then a refinement of each. Byte values map to coefficients whose magnitude category
never changes, so every code has the same length and whole scans are packed and unpacked by numpy; the stream is an
ordinary progressive JPEG all the same. The decoder reads any progressive Huffman JPEG with 8-bit samples; it accumulates
the scans into coefficient arrays, inverse-transforms in numpy and upsamples chroma.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS = ((1, 5), (6, 63))
#: DC values of odd and even blocks lie this far apart, so that each difference has nine bits.
SWING = 383
TAG = b"payload "
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order: along antidiagonals, turning at each."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else -x[0]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _inverse_dct() -> np.ndarray:
    """64 zigzag coefficients -> 64 samples, as one matrix."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.ascontiguousarray(np.kron(one, one)[:, ZIGZAG].T).astype(np.float32)


INVERSE = _inverse_dct()


def pad(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload): UTF-8, then bytes 32 up to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b" " * (-len(raw) % 192 if raw else 192)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(component: int, low: int, high: int, ah: int, al: int, table: int, bits: bytes) -> bytes:
    head = bytes([1, component, table, low, high, ah << 4 | al])
    return _segment(0xDA, head) + bits.replace(b"\xff", b"\xff\x00")


def _packed(rows: np.ndarray) -> bytes:
    """0/1 rows as one bit string; the last byte is filled with ones."""
    flat = rows.ravel()
    return np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])).tobytes()


def _head(w: int, h: int, comment: bytes) -> bytes:
    out = [b"\xff\xd8", _segment(0xFE, comment), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out.append(_segment(0xC2, frame))
    # Each table has one code, the bit 0: DC differences of nine bits; new coefficients of seven; end of block.
    for kind, symbol in ((0x00, 9), (0x10, 7), (0x11, 0)):
        out.append(_segment(0xC4, bytes([kind, 1, *[0] * 15, symbol])))
    return b"".join(out)


def encode(payload: bytes) -> bytes:
    """payload (a positive multiple of 192 bytes) as a progressive JPEG."""
    units = -(-len(payload) // 384)
    w = 64
    while w * 4095 < units:
        w *= 2
    w = min(w, units)
    h = -(-units // w)
    data = np.zeros(384 * w * h, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    out, blocks, at = [_head(w, h, TAG + str(len(payload)).encode())], data.reshape(-1, 64), 0
    for component, n in ((1, 4 * w * h), (2, w * h), (3, w * h)):
        own = blocks[at : at + n]
        at += n
        dc = (own[:, 0] >> 1).astype(np.int64)
        dc[0::2] += SWING
        diff = np.diff(dc, prepend=0)
        amplitude = np.where(diff < 0, diff + 511, diff)
        bits = (amplitude[:, None] >> np.arange(9, -1, -1)) & 1  # the code 0, then nine bits
        out.append(_scan(component, 0, 0, 0, 1, 0x00, _packed(bits.astype(np.uint8))))
        size = np.where(own >= 128, own, 255 - own)
        first = np.where(own >= 128, size >> 1, 127 - (size >> 1)).astype(np.uint8)  # the code 0, then seven bits
        for low, high in BANDS:
            out.append(_scan(component, low, high, 0, 1, 0x00, np.ascontiguousarray(first[:, low : high + 1]).tobytes()))
        out.append(_scan(component, 0, 0, 1, 0, 0x00, _packed(own[:, 0] & 1)))
        for low, high in BANDS:
            rows = np.zeros((n, high - low + 2), np.uint8)  # end of block, then a bit for each coefficient
            rows[:, 1:] = size[:, low : high + 1] & 1
            out.append(_scan(component, low, high, 1, 0, 0x01, _packed(rows)))
    return b"".join(out) + b"\xff\xd9"


@dataclass
class Component:
    h: int
    v: int
    quant: int
    across: int = 0
    down: int = 0
    wide: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Picture:
    width: int
    height: int
    components: dict[int, Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""


class _Bits:
    """Bit reader of the general path."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n]:
            value = 2 * value + b
        value <<= max(0, self.at + n - len(self.bits))
        self.at += n
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = 2 * code + self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def _codes(body: bytes, at: int) -> tuple[dict[tuple[int, int], int], int]:
    counts, at = body[at : at + 16], at + 16
    table, code = {}, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            table[n, code] = body[at]
            code, at = code + 1, at + 1
        code *= 2
    return table, at


def _uniform(table: dict | None, symbol: int) -> bool:
    return table is not None and table == {(1, 0): symbol}


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)


def _fast_scan(c: Component, n: int, low: int, high: int, ah: int, al: int, dc: dict | None, ac: dict | None, data: bytes) -> bool:
    """A scan of one component whose codes all have one length; False where it isn't one."""
    own = c.coefficients
    if low == 0 and ah:
        if len(data) * 8 < n:
            return False
        own[:, 0] |= _unpack(data, n, 1)[:, 0].astype(np.int32) << al
        return True
    if low == 0 and _uniform(dc, 9) and len(data) * 8 >= 10 * n:
        bits = _unpack(data, n, 10)
        if bits[:, 0].any():
            return False
        value = bits[:, 1:].astype(np.int32) @ (1 << np.arange(8, -1, -1)).astype(np.int32)
        own[:, 0] = np.cumsum(np.where(value >= 256, value, value - 511)) << al
        return True
    wide = high - low + 1
    if low and not ah and _uniform(ac, 7) and len(data) == n * wide:
        value = np.frombuffer(data, np.uint8).reshape(n, wide).astype(np.int32)
        if (value > 127).any():
            return False
        own[:, low : high + 1] = np.where(value >= 64, value, value - 127) * (1 << al)
        return True
    if low and ah and _uniform(ac, 0) and own[:, low : high + 1].all() and len(data) * 8 >= n * (wide + 1):
        bits = _unpack(data, n, wide + 1)[:, 1:].astype(np.int32) << al
        band = own[:, low : high + 1]
        own[:, low : high + 1] = np.where(band > 0, band + bits, band - bits)
        return True
    return False


def _block_scan(block, bits: _Bits, low: int, high: int, ah: int, al: int, table: dict, run: int) -> int:
    """AC coefficients low..high of one block; returns how many further blocks end at once."""
    one, k = 1 << al, low

    def refine(k: int) -> None:
        if bits.take(1):
            block[k] += one if block[k] > 0 else -one

    if not ah:
        if run:
            return run - 1
        while k <= high:
            zeros, size = divmod(bits.symbol(table), 16)
            if size:
                k += zeros
                block[k] = bits.signed(size) * one
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) + bits.take(zeros) - 1
        return 0
    if not run:
        while k <= high:
            zeros, size = divmod(bits.symbol(table), 16)
            value = 0
            if size:
                value = one if bits.take(1) else -one
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= high:
                if block[k]:
                    refine(k)
                elif zeros:
                    zeros -= 1
                else:
                    if value:
                        block[k] = value
                    k += 1
                    break
                k += 1
    if run:
        for j in range(k, high + 1):
            if block[j]:
                refine(j)
        return run - 1
    return 0


def _slow_scan(picture: Picture, parts: list[tuple[Component, dict | None, dict | None]], low: int, high: int, ah: int, al: int, restart: int, chunks: list[bytes]) -> None:
    if len(parts) == 1:
        c = parts[0][0]
        order = [[(0, r * c.wide + x)] for r in range(c.down) for x in range(c.across)]
    else:
        most_h, most_v = max(c.h for c in picture.components.values()), max(c.v for c in picture.components.values())
        units = [(y, x) for y in range(-(-picture.height // (8 * most_v))) for x in range(-(-picture.width // (8 * most_h)))]
        order = [[(i, (y * c.v + v) * c.wide + x * c.h + h) for i, (c, _, _) in enumerate(parts) for v in range(c.v) for h in range(c.h)] for y, x in units]
    step = restart or len(order)
    for chunk, begin in zip(chunks, range(0, len(order), step), strict=False):
        bits, last, run = _Bits(chunk), [0] * len(parts), 0
        for unit in order[begin : begin + step]:
            for i, b in unit:
                c, dc, ac = parts[i]
                block = c.coefficients[b]
                if low:
                    run = _block_scan(block, bits, low, high, ah, al, ac, run)
                elif ah:
                    block[0] |= bits.take(1) << al
                else:
                    last[i] += bits.signed(bits.symbol(dc))
                    block[0] = last[i] << al


def decode(data: bytes) -> Picture:
    """The coefficient arrays (zigzag order, not yet dequantised) of a progressive Huffman JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    picture, tables, restart, at = Picture(0, 0, {}, {}), {}, 0, 2
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            picture.comment = body
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDB:
            p = 0
            while p < len(body):
                wide = body[p] >> 4
                picture.quants[body[p] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, p + 1).astype(np.int32)
                p += 65 + 64 * wide
        elif marker == 0xC4:
            p = 0
            while p < len(body):
                key = body[p]
                tables[key], p = _codes(body, p + 1)
        elif marker == 0xC2:
            _, picture.height, picture.width, n = struct.unpack_from(">BHHB", body)
            for i in range(n):
                key, hv, quant = body[6 + 3 * i : 9 + 3 * i]
                picture.components[key] = Component(hv >> 4, hv & 15, quant)
            most_h, most_v = max(c.h for c in picture.components.values()), max(c.v for c in picture.components.values())
            for c in picture.components.values():
                c.across, c.down = -(-picture.width * c.h // (8 * most_h)), -(-picture.height * c.v // (8 * most_v))
                c.wide = -(-picture.width // (8 * most_h)) * c.h
                c.coefficients = np.zeros((c.wide * -(-picture.height // (8 * most_v)) * c.v, 64), np.int32)
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("only progressive Huffman JPEG is read")
        elif marker == 0xDA:
            end = _MARKER.search(data, at)
            stop = end.start() if end else len(data)
            chunks = [x.replace(b"\xff\x00", b"\xff") for x in (_RESTART.split(data[at:stop]) if restart else [data[at:stop]])]
            at = stop
            n = body[0]
            keys = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
            low, high, a = body[1 + 2 * n : 4 + 2 * n]
            parts = [(picture.components[k], tables.get(t >> 4), tables.get(0x10 | t & 15)) for k, t in keys]
            c, dc, ac = parts[0]
            whole = n == 1 and not restart and len(c.coefficients) == c.across * c.down
            if not (whole and _fast_scan(c, len(c.coefficients), low, high, a >> 4, a & 15, dc, ac, chunks[0])):
                _slow_scan(picture, parts, low, high, a >> 4, a & 15, restart, chunks)
    return picture


def read_payload(picture: Picture) -> bytes:
    """The bytes that `encode` stored."""
    out = []
    for c in picture.components.values():
        own = c.coefficients
        data = np.where(own > 0, own, own + 255).astype(np.uint8)
        dc = own[:, 0].copy()
        dc[0::2] -= 2 * SWING
        data[:, 0] = dc
        out.append(data.tobytes())
    return b"".join(out)[: int(picture.comment.removeprefix(TAG))]


def rgb(picture: Picture) -> np.ndarray:
    """Full-resolution RGB, height x width x 3 of uint8; one component gives grey."""
    planes = []
    most_h, most_v = max(c.h for c in picture.components.values()), max(c.v for c in picture.components.values())
    for c in picture.components.values():
        samples = (c.coefficients * picture.quants[c.quant]).astype(np.float32) @ INVERSE
        plane = np.clip(samples + 128.0, 0, 255).reshape(-1, c.wide, 8, 8).swapaxes(1, 2).reshape(-1, 8 * c.wide)
        plane = plane.repeat(most_v // c.v, 0) if most_v > c.v else plane
        plane = plane.repeat(most_h // c.h, 1) if most_h > c.h else plane
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) == 1:
        return np.repeat(np.rint(planes[0]).astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
    out = np.empty((*y.shape, 3), np.uint8)
    for i, plane in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
        out[:, :, i] = plane
    return out


def feature(tensor: np.ndarray) -> str:
    """height x width and the mean of each channel, rounded down."""
    h, w, _ = tensor.shape
    means = tensor.reshape(-1, 3).sum(0, dtype=np.int64) // (h * w)
    return f"{h}x{w}:" + ",".join(map(str, means.tolist()))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = True, tensor: bool = True) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, height, width, tensor_sha256, and, where asked for, media (the JPEG) and tensor (height * width * 3 bytes).

    Digests of the payload are those of the bytes read back from the stored form. A null text is empty, and an empty
    text is 192 bytes 32. Equal texts give equal values; ids, nulls among them, pass through. An empty table gives an
    empty result. A task holds one document's picture at a time, a very long text's among them; its tensor has about
    twice the text's bytes.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "tensor_sha256", *["media"] * media, *["tensor"] * tensor]
    kinds = [own.schema["id"].dataType.simpleString(), "long", "long", "string", "long", "long", "string", "string", "int", "int", "string", *["binary"] * media, *["binary"] * tensor]

    def row(key, text: str | None) -> tuple:
        n, payload = pad(text)
        stored = encode(payload)
        picture = decode(stored)
        back, pixels = read_payload(picture), rgb(picture)
        out = (key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(pixels), picture.height, picture.width, hashlib.sha256(pixels).hexdigest())
        return out + (stored,) * media + (pixels.tobytes(),) * tensor

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out, held = [], 0
            schema = pa.schema([(c, batch.schema.field("id").type if c == "id" else {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[k]) for c, k in zip(names, kinds, strict=True)])
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                out.append(row(key, text.as_py()))
                held += sum(map(len, out[-1][11:]))
                if held > 1 << 26:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return own.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(names, kinds, strict=True))).withColumnRenamed("id", id_col)
