"""Pixels of JPEG files: sequential Huffman-coded ones of 8 bits (ITU T.81), as image columns.

A file's size is read from its header first, so an over-large one is set aside before anything is decoded. Codes are looked up
16 bits at a time; the inverse transform of all blocks of a component is two matrix products; colour planes of fewer samples
are repeated to full size.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .image import IMAGE, jpeg_dimensions, packed

DECODED = f"{IMAGE}, rejected string"
SOF_SEQUENTIAL, SOF_ALL = (0xC0, 0xC1), [m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC)]
DHT, SOS, DQT, DRI, EOI, APP14 = 0xC4, 0xDA, 0xDB, 0xDD, 0xD9, 0xEE


class JpegError(ValueError):
    """Not a file that can be decoded here; the message is short enough to be a reason."""


def zigzag() -> np.ndarray:
    """Places (row * 8 + column) in the order in which coefficients are stored: along diagonals, back and forth."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ORDER = zigzag()
#: The cosine basis, rows by frequency.
BASIS = np.array([[(np.sqrt(0.125) if k == 0 else 0.5) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


@dataclass
class Component:
    h: int
    v: int
    table: int
    blocks: np.ndarray | None = None
    dc: int = 0
    ac: int = 0
    last: int = 0


def lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits: the length of the code that they begin with, times 256, and its symbol; 0 where there is none."""
    out, code, at = np.zeros(1 << 16, dtype=np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length << 8 | s
            code += 1
        at += n
        code <<= 1
    return out.tolist()


class Bits:
    """The bits of a run between restart marks, stuffing taken out; zeros behind its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        self.held = (self.held & ((1 << self.n) - 1)) << 64 | int.from_bytes(part.ljust(8, b"\0"), "big")
        self.n += 64
        self.at += 8

    def coded(self, table: list[int]) -> int:
        if self.n < 32:
            self.fill()
        found = table[(self.held >> (self.n - 16)) & 0xFFFF]
        if not found:
            raise JpegError("bad-code")
        self.n -= found >> 8
        return found & 0xFF

    def signed(self, size: int) -> int:
        """A number of that many bits; those that begin with 0 are negative."""
        if not size:
            return 0
        if self.n < 32:
            self.fill()
        self.n -= size
        v = (self.held >> self.n) & ((1 << size) - 1)
        return v if v >> (size - 1) else v - (1 << size) + 1


def block(bits: Bits, c: Component, dc: list[int], ac: list[int], out: np.ndarray) -> None:
    c.last += bits.signed(bits.coded(dc))
    out[0], k = c.last, 1
    while k < 64:
        rs = bits.coded(ac)
        run, size = rs >> 4, rs & 15
        if not size:
            if run != 15:
                return
            k += 16
            continue
        k += run
        if k > 63:
            raise JpegError("bad-run")
        out[k] = bits.signed(size)
        k += 1


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.quant, self.codes, self.restart, self.colours = data, {}, {}, 0, None
        self.width = self.height = 0
        self.parts: dict[int, Component] = {}

    def decode(self) -> np.ndarray:
        """Pixels (height, width, 4)."""
        at, scans = 2, 0
        while at + 4 <= len(self.data):
            if self.data[at] != 0xFF:
                at += 1
                continue
            marker = self.data[at + 1]
            if marker == EOI:
                break
            if marker in (0x00, 0x01, 0xFF) or 0xD0 <= marker <= 0xD8:
                at += 1 if marker == 0xFF else 2
                continue
            size = struct.unpack_from(">H", self.data, at + 2)[0]
            body, at = self.data[at + 4 : at + 2 + size], at + 2 + size
            if marker == SOS:
                at = self.scan(body, at)
                scans += 1
            else:
                self.segment(marker, body)
        if not scans:
            raise JpegError("no-scan")
        return self.pixels()

    def segment(self, marker: int, body: bytes) -> None:
        if marker in SOF_SEQUENTIAL:
            bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3) or not self.height or not self.width:
                raise JpegError("unsupported")
            self.parts = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            if any(not 1 <= x <= 4 for c in self.parts.values() for x in (c.h, c.v)):
                raise JpegError("bad-sampling")
            self.h, self.v = max(c.h for c in self.parts.values()), max(c.v for c in self.parts.values())
            self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
            for c in self.parts.values():
                c.blocks = np.zeros((self.down * c.v, self.across * c.h, 64), dtype=np.int32)
        elif marker in SOF_ALL:
            raise JpegError("unsupported")
        elif marker == DQT:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                n = 64 * (1 + (wide > 0))
                self.quant[name] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                self.codes[body[0]] = lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == DRI:
            self.restart = struct.unpack(">H", body[:2])[0]
        elif marker == APP14 and body[:5] == b"Adobe" and len(body) >= 12:
            self.colours = body[11]

    def scan(self, head: bytes, at: int) -> int:
        """Reads the coded data behind a scan's head; where the next mark is."""
        parts = []
        for i in range(head[0]):
            c = self.parts.get(head[1 + 2 * i])
            if c is None:
                raise JpegError("bad-scan")
            c.dc, c.ac, c.last = head[2 + 2 * i] >> 4, 0x10 | head[2 + 2 * i] & 15, 0
            if c.dc not in self.codes or c.ac not in self.codes:
                raise JpegError("no-codes")
            parts.append(c)
        runs, start, end = [], at, at
        while True:
            end = self.data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(self.data):
                end = len(self.data)
                break
            after = self.data[end + 1]
            if 0xD0 <= after <= 0xD7:
                runs.append(self.data[start:end])
                start = end = end + 2
            elif after:
                break
            else:
                end += 2
        runs.append(self.data[start:end])
        units = self.units(parts)
        per = self.restart or len(units)
        for i, run in enumerate(runs):
            bits = Bits(run)
            for c in parts:
                c.last = 0
            for unit in units[i * per : (i + 1) * per]:
                for c, y, x in unit:
                    block(bits, c, self.codes[c.dc], self.codes[c.ac], c.blocks[y, x])
        return end

    def units(self, parts: list[Component]) -> list[list[tuple[Component, int, int]]]:
        """The blocks of a scan by units: all parts of a square together, or of one part its own blocks row by row."""
        if len(parts) == 1:
            c = parts[0]
            wide, high = -(-self.width * c.h // (8 * self.h)), -(-self.height * c.v // (8 * self.v))
            return [[(c, y, x)] for y in range(high) for x in range(wide)]
        return [[(c, y * c.v + j, x * c.h + i) for c in parts for j in range(c.v) for i in range(c.h)] for y in range(self.down) for x in range(self.across)]

    def plane(self, c: Component) -> np.ndarray:
        """A component's samples, repeated to the picture's size."""
        if c.table not in self.quant:
            raise JpegError("no-table")
        rows, columns = c.blocks.shape[:2]
        values = np.zeros((rows, columns, 64))
        values[..., ORDER] = c.blocks * self.quant[c.table]
        values = BASIS.T @ values.reshape(rows, columns, 8, 8) @ BASIS
        levels = np.clip(np.floor(values + 128.5), 0, 255).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        y, x = np.arange(self.height) * c.v // self.v, np.arange(self.width) * c.h // self.h
        return levels[y][:, x]

    def pixels(self) -> np.ndarray:
        planes = [self.plane(c) for c in self.parts.values()]
        if len(planes) == 1:
            rgb = planes * 3
        elif self.colours == 0:
            rgb = planes
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            rgb = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
        out = np.full((self.height, self.width, 4), 255, dtype=np.uint8)
        for i, p in enumerate(rgb):
            out[..., i] = np.clip(np.floor(p + 0.5), 0, 255)
        return out


def decode(data: bytes | None, max_pixels: int) -> tuple[np.ndarray | None, str | None]:
    """(pixels, None), or (None, why not)."""
    size = jpeg_dimensions(data)
    if size is None:
        return None, "no-header"
    if size[0] * size[1] > max_pixels:
        return None, "too-large"
    try:
        return Decoder(data).decode(), None
    except JpegError as e:
        return None, str(e)
    except (IndexError, struct.error, ValueError):
        return None, "broken"


def jpeg_image(data: Column, max_pixels: int) -> Column:
    """The image of a JPEG file's bytes, and why there is none."""

    @F.pandas_udf(DECODED)
    def udf(files: pd.Series) -> pd.DataFrame:
        out = []
        for f in files:
            pixels, why = decode(f, max_pixels)
            out.append((*(packed(pixels) if pixels is not None else (None, None, None)), why))
        return pd.DataFrame(out, columns=["data", "width", "height", "rejected"])

    return udf(data)
