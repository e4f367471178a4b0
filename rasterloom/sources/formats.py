"""Image files that Spark's image source doesn't read: PNM, TGA, PSD and Radiance HDR, told apart by their first bytes.

Decoders give 8-bit (height, width, 3) arrays. Grey images repeat their value, alpha is dropped, 16-bit samples keep
their high byte, and HDR's light is brought to bytes by a gamma of 2.2.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FORMATS = ("pnm", "tga", "psd", "hdr")


def sniff(data: bytes) -> str | None:
    """The format of a file, or None: TGA has no magic, so its header's fields must be sound."""
    if data[:2] in (b"P5", b"P6") and data[2:3].isspace():
        return "pnm"
    if data[:4] == b"8BPS":
        return "psd"
    if data[:10] == b"#?RADIANCE" or data[:6] == b"#?RGBE":
        return "hdr"
    if len(data) > 18 and data[1] in (0, 1) and data[2] in (1, 2, 3, 9, 10, 11) and data[16] in (8, 15, 16, 24, 32) and 0 not in struct.unpack_from("<HH", data, 12):
        return "tga"
    return None


def _three(a: np.ndarray) -> np.ndarray:
    """Grey, grey with alpha, colour or colour with alpha as colour."""
    return np.repeat(a[..., :1], 3, -1) if a.shape[-1] < 3 else a[..., :3]


def decode_pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        found = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)").match(data, at)
        if not found:
            raise ValueError("broken PNM header")
        fields.append(int(found[1]))
        at = found.end()
    (w, h, most), s = fields, 3 if data[1:2] == b"6" else 1
    a = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h * s, at + 1).reshape(h, w, s)
    return _three((a >> 8 if most > 255 else a).astype(np.uint8))


def decode_tga(data: bytes) -> np.ndarray:
    skip, mapped, kind = data[:3]
    first, entries, entry_bits = struct.unpack_from("<HHB", data, 3)
    w, h, bits, flags = struct.unpack_from("<HHBB", data, 12)
    at, size = 18 + skip, (bits + 7) // 8
    table = np.frombuffer(data, np.uint8, entries * ((entry_bits + 7) // 8), at).reshape(entries, -1) if mapped else None
    at += 0 if table is None else table.size
    if kind < 8:
        a = np.frombuffer(data, np.uint8, w * h * size, at)
    else:
        out, need = bytearray(), w * h * size
        while len(out) < need:
            n, at = (data[at] & 127) + 1, at + 1
            if data[at - 1] & 128:
                out += data[at : at + size] * n
                at += size
            else:
                out += data[at : at + size * n]
                at += size * n
        a = np.frombuffer(bytes(out), np.uint8, need)
    a = a.reshape(h, w, size)
    if table is not None:
        a = table[(a[..., 0].astype(int) if size == 1 else a.copy().view("<u2")[..., 0].astype(int)) - first]
    if a.shape[-1] == 2:  # five bits each of red, green and blue
        v = np.ascontiguousarray(a).view("<u2")[..., 0].astype(int)
        a = np.stack([(v >> k & 31) * 255 // 31 for k in (10, 5, 0)], -1)
    elif a.shape[-1] >= 3:
        a = a[..., 2::-1]
    a = a if flags & 32 else a[::-1]
    return _three((a[:, ::-1] if flags & 16 else a).astype(np.uint8))


def decode_psd(data: bytes) -> np.ndarray:
    version, channels, h, w, depth, mode = struct.unpack_from(">H6xHIIHH", data, 4)
    if version != 1 or depth not in (8, 16) or mode != 3:
        raise ValueError("a PSD must be RGB of 8 or 16 bits")
    at = 26
    for _ in range(3):  # colour table, resources, layers
        at += 4 + struct.unpack_from(">I", data, at)[0]
    (packed,) = struct.unpack_from(">H", data, at)
    at += 2
    if packed == 0:
        a = np.frombuffer(data, ">u2" if depth == 16 else np.uint8, channels * h * w, at)
        planes = (a >> 8 if depth == 16 else a).astype(np.uint8)
    elif packed == 1 and depth == 8:
        at += 2 * channels * h
        out, need = bytearray(), channels * h * w
        while len(out) < need:
            n = data[at]
            if n < 128:
                out += data[at + 1 : at + 2 + n]
                at += n + 2
            else:
                out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
                at += 2 if n > 128 else 1
        planes = np.frombuffer(bytes(out), np.uint8, need)
    else:
        raise ValueError("an unknown PSD compression")
    planes = planes.reshape(channels, h, w)
    return np.stack([planes[min(k, channels - 1)] for k in range(3)], -1)


def decode_hdr(data: bytes) -> np.ndarray:
    found = re.search(rb"\n\n-Y (\d+) \+X (\d+)\n", data)
    if not found:
        raise ValueError("broken HDR header")
    h, w, at = int(found[1]), int(found[2]), found.end()
    rows = np.zeros((h, w, 4), np.uint8)
    for y in range(h):
        if not (8 <= w < 32768 and data[at : at + 2] == b"\2\2" and data[at + 2] < 128):
            rows[y] = np.frombuffer(data, np.uint8, 4 * w, at).reshape(w, 4)
            at += 4 * w
            continue
        at += 4
        for k in range(4):
            x = 0
            while x < w:
                n = data[at]
                if n > 128:
                    rows[y, x : x + n - 128, k] = data[at + 1]
                    x, at = x + n - 128, at + 2
                else:
                    rows[y, x : x + n, k] = np.frombuffer(data, np.uint8, n, at + 1)
                    x, at = x + n, at + 1 + n
    light = rows[..., :3] * np.where(rows[..., 3:] > 0, np.ldexp(1.0, rows[..., 3:].astype(int) - 136), 0.0)
    return np.clip(light ** (1 / 2.2) * 255 + 0.5, 0, 255).astype(np.uint8)


DECODE = {"pnm": decode_pnm, "tga": decode_tga, "psd": decode_psd, "hdr": decode_hdr}


def encode(rgb: np.ndarray, kind: str) -> bytes:
    """A file of an (height, width, 3) array: binary PNM, run-length TGA, plain PSD, flat HDR of light = byte / 256."""
    h, w, _ = rgb.shape
    if kind == "pnm":
        return b"P6\n# pixels\n%d %d\n255\n" % (w, h) + rgb.tobytes()
    if kind == "tga":
        flat, out = rgb[..., ::-1].reshape(-1, 3), bytearray()
        for start in np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]).any(1))).tolist():
            rest = np.flatnonzero((flat[start:] != flat[start]).any(1))
            n = int(rest[0]) if len(rest) else len(flat) - start
            for k in range(0, n, 128):
                out += bytes((127 + min(128, n - k),)) + flat[start].tobytes()
        return struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, w, h, 24, 32) + bytes(out)
    if kind == "psd":
        return b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, h, w, 8, 3) + bytes(12) + struct.pack(">H", 0) + rgb.transpose(2, 0, 1).tobytes()
    shared = np.full((h, w, 1), 128, np.uint8)
    return b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y %d +X %d\n" % (h, w) + np.concatenate([rgb, shared], -1).tobytes()


def write_files(pixels: DataFrame) -> DataFrame:
    """image_id and data of each image (image_id, y, x, r, g, b), in the format that its number is due."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1, 3), np.uint8)
        a[pdf.y, pdf.x] = pdf[["r", "g", "b"]]
        image_id = int(pdf.image_id.iloc[0])
        return pd.DataFrame({"image_id": [image_id], "data": [encode(a, FORMATS[image_id % len(FORMATS)])]})

    return pixels.groupBy("image_id").applyInPandas(pack, "image_id long, data binary")


def read_files(files: DataFrame, key: str, column: str) -> DataFrame:
    """Pixels of files' bytes: image_id (the key), format, y, x, r, g, b. Bytes of no known format give no rows; broken ones raise."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for image_id, data in zip(pdf[key], pdf[column], strict=True):
                if (kind := sniff(data)) is None:
                    continue
                a = DECODE[kind](data)
                y, x = np.divmod(np.arange(a.shape[0] * a.shape[1]), a.shape[1])
                r, g, b = a.reshape(-1, 3).T.astype(np.int32)
                yield pd.DataFrame({"image_id": image_id, "format": kind, "y": y, "x": x, "r": r, "g": g, "b": b})

    return files.select(key, column).mapInPandas(unpack, "image_id long, format string, y int, x int, r int, g int, b int")
