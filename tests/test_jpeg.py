"""JPEG pixels against a plain encoder whose coefficients are known, and the inverse transform by loops."""

import math
import struct

import numpy as np
import pytest

from tessera.functions import jpeg
from tessera.sources import media_files

QUANT = np.array([1 + (i // 8 + i % 8) for i in range(64)])  # by place, not in the stored order


def cosine(u, x):
    return (math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16)


def forward(block):
    return [round(sum(cosine(v, y) * cosine(u, x) * (block[y][x] - 128) for y in range(8) for x in range(8)) / QUANT[v * 8 + u]) for v in range(8) for u in range(8)]


def inverse(values):
    return [[min(255, max(0, math.floor(sum(cosine(v, y) * cosine(u, x) * values[v * 8 + u] * QUANT[v * 8 + u] for v in range(8) for u in range(8)) + 128.5))) for x in range(8)] for y in range(8)]


def path_order():
    """Places along the diagonals, walked step by step."""
    out, r, c, up = [], 0, 0, True
    while len(out) < 64:
        out.append(r * 8 + c)
        if up:
            r, c, up = (r + 1, c, False) if c == 7 else (r, c + 1, False) if r == 0 else (r - 1, c + 1, True)
        else:
            r, c, up = (r, c + 1, True) if r == 7 else (r + 1, c, True) if c == 0 else (r + 1, c - 1, False)
    return out


class Writer:
    def __init__(self):
        self.bits = ""

    def code(self, symbol):
        self.bits += f"{symbol:08b}" if symbol < 254 else f"{508 + symbol - 254:09b}"  # as the table of `encoded` deals codes

    def number(self, v):
        n = abs(v).bit_length()
        return n, (f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else "")

    def block(self, values, last):
        stored = [values[p] for p in path_order()]
        n, bits = self.number(stored[0] - last)
        self.code(n)
        self.bits += bits
        run = 0
        end = max((i for i in range(1, 64) if stored[i]), default=0)
        for v in stored[1 : end + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                self.code(0xF0)
                run -= 16
            n, bits = self.number(v)
            self.code(run << 4 | n)
            self.bits += bits
            run = 0
        if end < 63:
            self.code(0)
        return stored[0]

    def take(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        self.bits = ""
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def encoded(planes, sampling, width, height, restart=0, adobe=None, sof=0xC0):
    """A file of planes (padded to whole units), and each plane's samples after coding."""
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    values = [[[forward(p[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].tolist()) for x in range(p.shape[1] // 8)] for y in range(p.shape[0] // 8)] for p in planes]
    out = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes(QUANT[path_order()].tolist()))
    if adobe is not None:
        out += segment(0xEE, b"Adobe" + bytes(6) + bytes([adobe]))
    out += segment(sof, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, s[0] << 4 | s[1], 0]) for i, s in enumerate(sampling)))
    counts = bytes([0] * 7 + [254, 2] + [0] * 7)
    for kind in (0x00, 0x10):
        out += segment(0xC4, bytes([kind]) + counts + bytes(range(256)))
    if restart:
        out += segment(0xDD, struct.pack(">H", restart))
    out += segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + bytes([0, 63, 0]))
    w, last, n = Writer(), [0] * len(planes), 0
    single = len(planes) == 1
    units = [(y, x) for y in range(-(-height // 8) if single else down) for x in range(-(-width // 8) if single else across)]
    for i, (y, x) in enumerate(units):
        for k, s in enumerate(sampling):
            for j in range(1 if single else s[1]):
                for m in range(1 if single else s[0]):
                    last[k] = w.block(values[k][y * (1 if single else s[1]) + j][x * (1 if single else s[0]) + m], last[k])
        if restart and (i + 1) % restart == 0 and i + 1 < len(units):
            out += w.take() + bytes([0xFF, 0xD0 + n % 8])
            n, last = n + 1, [0] * len(planes)
    coded = [np.block([[np.array(inverse(b)) for b in row] for row in rows]) for rows in values]
    return out + w.take() + b"\xff\xd9", coded


def smooth(rng, height, width):
    y, x = np.mgrid[0:height, 0:width]
    return np.clip(120 + 60 * np.sin(x / 5 + rng.random()) + 50 * np.cos(y / 4) + rng.integers(-20, 20, (height, width)), 0, 255).astype(int)


@pytest.mark.parametrize(("sampling", "restart", "adobe"), [([(1, 1)], 0, None), ([(2, 2)], 3, None), ([(1, 1)] * 3, 0, None), ([(2, 2), (1, 1), (1, 1)], 2, 1), ([(2, 1), (1, 1), (1, 1)], 0, None), ([(1, 1)] * 3, 0, 0)])
def test_pixels_against_the_encoder(sampling, restart, adobe):
    rng, (width, height) = np.random.default_rng(1), (29, 21)
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    data, coded = encoded([smooth(rng, down * 8 * s[1], across * 8 * s[0]) for s in sampling], sampling, width, height, restart, adobe)
    got, why = jpeg.decode(data, 10_000)
    assert why is None and got.shape == (height, width, 4) and (got[..., 3] == 255).all()
    full = [[[int(p[y * s[1] // v][x * s[0] // h]) for x in range(width)] for y in range(height)] for p, s in zip(coded, sampling, strict=True)]
    for y in range(height):
        for x in range(width):
            a = [p[y][x] for p in full]
            if len(a) == 3 and adobe != 0:
                a = [a[0] + 1.402 * (a[2] - 128), a[0] - 0.344136 * (a[1] - 128) - 0.714136 * (a[2] - 128), a[0] + 1.772 * (a[1] - 128)]
            want = [min(255, max(0, c)) for c in (a if len(a) == 3 else a * 3)]
            assert max(abs(float(got[y, x, c]) - want[c]) for c in range(3)) <= 1


def test_what_is_not_decoded(spark, tmp_path):
    rng = np.random.default_rng(2)
    data, _ = encoded([smooth(rng, 16, 16)], [(1, 1)], 16, 16)
    assert jpeg.decode(data, 255) == (None, "too-large") and jpeg.decode(b"no", 9) == jpeg.decode(None, 9) == (None, "no-header")
    assert jpeg.decode(data.replace(b"\xff\xc0", b"\xff\xc2"), 256) == (None, "unsupported")
    assert jpeg.decode(data[: data.index(b"\xff\xda")], 256)[1] == "no-scan" and jpeg.decode(data.replace(b"\xff\xdb", b"\xff\xe5"), 256)[1] == "no-table"
    for cut in range(len(data) - 40, len(data), 7):
        pixels, why = jpeg.decode(data[:cut], 256)
        assert (pixels is None) == (why is not None)
    for name, content in (("a.jpg", data), ("b.jpg", b"no"), ("c.jpeg", data.replace(b"\xff\xc0", b"\xff\xc2"))):
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in media_files.jpeg_images(spark, f"file://{tmp_path}").collect()}
    assert {n: r.rejected for n, r in got.items()} == {"a.jpg": None, "b.jpg": "no-header", "c.jpeg": "unsupported"}
    assert bytes(got["a.jpg"].image.data) == jpeg.decode(data, 256)[0].tobytes() and got["b.jpg"].image is None
    assert {r.rejected for r in media_files.jpeg_images(spark, f"file://{tmp_path}", 10).collect()} == {"too-large", "no-header"}


def test_stored_order():
    assert jpeg.ORDER.tolist() == path_order()
