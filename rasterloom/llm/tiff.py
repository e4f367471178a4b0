"""TIFF as a media column: bytes in, one row per page out."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the TIFF 6.0 format: tag numbers, field types and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: By default a page of more bytes than this is an error row, so that a forged header can't exhaust memory.
MAX_PAGE = 1 << 30
#: No limit: the format's own offsets have 32 bits, and a Spark string ends at half of that.
WHOLE = 1 << 32
#: Bytes of pixels in an output batch, beyond which the next one begins.
OUT_BYTES = 4 << 20


def packbits_decode(data: bytes, most: int = WHOLE) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, most: int = WHOLE) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widening one code early; 256 clears, 257 ends."""
    out, bits, held, at, width = bytearray(), 0, 0, 0, 9
    words: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    last = b""
    while len(out) < most:
        while held < width:
            if at >= len(data):
                return bytes(out)
            bits, held, at = (bits << 8 | data[at]) & 0xFFFFFFFF, held + 8, at + 1
        held -= width
        code = bits >> held & ((1 << width) - 1)
        if code == 257:
            return bytes(out)
        if code == 256:
            del words[258:]
            width, last = 9, b""
            continue
        if not last:
            last = words[code]
        else:
            if code > len(words):
                raise ValueError("broken LZW stream")
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
            last = word
        out += last
        if len(words) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, held, width = bytearray(), 0, 0, 9
    words = {bytes((i,)): i for i in range(256)}
    size, word = 258, b""

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in words:
            word = longer
            continue
        put(words[word])
        words[longer], size, word = size, size + 1, data[i : i + 1]
        if size + 1 > 1 << width:
            width += 1
        if size >= 4094:
            put(256)
            words, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
    if word:
        put(words[word])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


ENCODE = {NONE: lambda b: b, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}


def _decode(kind: int, data: bytes, most: int) -> bytes:
    if kind == NONE:
        return data
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if kind == LZW:
        return lzw_decode(data, most)
    if kind == PACKBITS:
        return packbits_decode(data, most)
    raise ValueError(f"compression {kind} is not supported")


def encode_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 256, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file of 8- or 16-bit pages, each (height, width) or (height, width, samples)."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        a = page[..., None] if page.ndim == 2 else page
        h, w, s = a.shape
        kind = a.dtype.newbyteorder("<")
        if tile:
            th, tw = tile
            full = np.zeros((-(-h // th) * th, -(-w // tw) * tw, s), a.dtype)
            full[:h, :w] = a
            parts = [full[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
        else:
            parts = [a[y : y + rows] for y in range(0, h, rows)]
        at, size = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1)
            data = ENCODE[compression](part.astype(kind).tobytes())
            at.append(len(out))
            size.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8 * a.dtype.itemsize] * s), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if s == 3 else 1]), (SAMPLES, 3, [s]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tw]), (TILE_HEIGHT, 4, [th]), (TILE_OFFSETS, 4, at), (TILE_COUNTS, 4, size)] if tile else [(STRIP_OFFSETS, 4, at), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, size)]
        entries = b""
        for tag, field, values in sorted(tags):
            data = struct.pack(f"<{len(values)}{FIELD[field]}", *values)
            if len(data) > 4:
                where, out = len(out), out + data + b"\0" * (len(data) % 2)
                data = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, field, len(values)) + data.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of each image directory, following the chain; a loop in it ends the walk with an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    seen, at = set(), struct.unpack_from(f"{order}I", data, 4)[0]
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(f"{order}H", data, at)
        tags = {}
        for i in range(n):
            tag, field, count = struct.unpack_from(f"{order}HHI", data, where := at + 2 + 12 * i)
            if field not in FIELD:
                continue
            form = f"{order}{count}{FIELD[field]}"
            tags[tag] = struct.unpack_from(form, data, where + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(f"{order}I", data, where + 8)[0])
        yield order, tags
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def _samples(raw: bytes, rows: int, count: int, each: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """(rows, count) samples of a decoded strip or tile whose pixels have `each` of them, the predictor undone; floats as their bits."""
    line = -(-count * bits // 8)
    if len(raw) < rows * line:
        raise ValueError("a strip or tile is too short")
    a = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line)
    if bits < 8:  # most significant bits first, rows begin on a byte
        a = np.unpackbits(a, axis=1)[:, : count * bits].reshape(rows, count, bits) @ (1 << np.arange(bits)[::-1]).astype(np.uint8)
    elif predictor == 3:  # differences of bytes, dealt to planes from the highest byte down
        planes = np.cumsum(a.reshape(rows, -1, each), 1, np.uint8).reshape(rows, bits // 8, count)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{bits // 8}")[..., 0]
    else:
        a = a.view(f"{order}u{bits // 8}")
    if predictor == 2:
        a = np.cumsum(a.reshape(rows, -1, each), 1, a.dtype.newbyteorder("=")).reshape(rows, count) & a.dtype.type((1 << bits) - 1)
    return a


def page_pixels(data: bytes, order: str, tags: dict[int, tuple], most: int = MAX_PAGE) -> np.ndarray:
    """(height, width, samples) of one directory: strips or tiles, chunky or planar, predictors undone."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, s, kind = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, NONE)
    depth, planar, predictor = set(tags.get(BITS, (1,))), one(PLANAR, 1) == 2, one(PREDICTOR, 1)
    bits = max(depth)
    if len(depth) > 1 or bits not in (1, 2, 4, 8, 16, 32) or predictor not in (1, 2, 3) or predictor == 3 and bits < 16:
        raise ValueError(f"{depth} bits a sample with predictor {predictor} are not supported")
    size = max(1, bits // 8)
    if w * h * s * size > most:
        raise ValueError("the page is too large")
    each = 1 if planar else s
    tiled = TILE_OFFSETS in tags
    pw, ph = (one(TILE_WIDTH, w), one(TILE_HEIGHT, h)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    at, count = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    if min(pw, ph) < 1 and w * h:
        raise ValueError("a strip or tile has no pixels")
    out = np.zeros((h, w, s), f"u{size}")
    k = 0
    for plane in range(s if planar else 1):
        for y in range(0, h, ph):
            for x in range(0, w, pw):
                rows = ph if tiled else min(ph, h - y)
                raw = _decode(kind, data[at[k] : at[k] + count[k]], rows * -(-pw * each * bits // 8))
                part = _samples(raw, rows, pw * each, each, bits, predictor, order).reshape(rows, pw, each)
                here = out[y : y + rows, x : x + pw]
                here[..., plane : plane + each] = part[: here.shape[0], : here.shape[1]]
                k += 1
    return out


PAGES = "page int, width int, height int, samples int, bits int, compression int, pixels binary, error string"


def read_pages(media: DataFrame, column: str, keep: list[str], most: int = MAX_PAGE) -> DataFrame:
    """One row per page of the TIFF files in a binary column, with the columns in keep.

    page counts from 0; bits are those that a pixel's sample takes here, 8 for smaller ones. A null file gives no row. A file or page that can't be read gives one row with
    the reason in error and null pixels, after the pages before it; so does a
    page of more than `most` bytes, and the job goes on. Rows are
    independent, so repeated rows repeat their pages. A narrow map, no shuffle.
    """
    kinds = dict(media.dtypes)
    return media.select(column, *[k for k in keep if k != column]).mapInArrow(lambda b: page_batches(b, column, keep, most), ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), PAGES]))


def page_batches(batches: Iterator[pa.RecordBatch], column: str, keep: list[str], most: int = MAX_PAGE) -> Iterator[pa.RecordBatch]:
    """The worker's side of read_pages: a few files at a time, so that decoded pages don't pile up."""
    names = [f.split()[0] for f in PAGES.split(", ")]
    types = [pa.int32()] * 6 + [pa.binary(), pa.string()]

    def out(batch: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [batch.column(k).take(pa.array(of, pa.int64())) for k in keep]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[j] for r in rows], types[j]) for j in range(8))], [*keep, *names])

    for batch in batches:
        rows, of, held = [], [], 0
        for i, cell in enumerate(batch.column(column)):
            data, page = cell.as_py(), 0
            if data is None:
                continue
            try:
                for order, tags in directories(data):
                    a = page_pixels(data, order, tags, most)
                    rows.append((page, a.shape[1], a.shape[0], a.shape[2], 8 * a.dtype.itemsize, tags.get(COMPRESSION, (1,))[0], a.tobytes(), None))
                    of.append(i)
                    page += 1
                    held += a.nbytes
                    if held > OUT_BYTES:
                        yield out(batch, of, rows)
                        rows, of, held = [], [], 0
            except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                rows.append((page, *[None] * 6, f"{type(e).__name__}: {e}"))
                of.append(i)
        yield out(batch, of, rows)


#: Bytes of a row of the page that holds a text.
ROW = 192


def media_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stores each text (null: empty), padded with spaces to whole rows, as one grey page."""
    for batch in batches:
        n, media = [], []
        for text in batch.column("text").to_pylist():
            data = (text or "").encode()
            n.append(len(data))
            data = data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b" ")
            media.append(encode_tiff([np.frombuffer(data, np.uint8).reshape(-1, ROW)]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests and features of pages that hold a text: those of the pixels as read back and of the stored file."""
    for batch in batches:
        rows = []
        for pixels, media, w, h, error in zip(*(batch.column(k).to_pylist() for k in ("pixels", "media", "width", "height", "error")), strict=True):
            if error:
                raise ValueError(f"a stored text can't be read back: {error}")
            a = np.frombuffer(pixels, np.uint8)
            share = np.bincount(a, minlength=256) / len(a)
            bits = -(p := share[share > 0]) @ np.log2(p)
            edges = np.abs(np.diff(a.reshape(h, w).astype(np.int16), axis=0)).mean() if h > 1 else 0
            feature = f"{w}x{h} mean={a.mean():.4f} std={a.std():.4f} entropy={bits:.4f} edges={edges:.4f}"
            rows.append((len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def text_digests(docs: DataFrame) -> DataFrame:
    """Per document: its text stored as a TIFF page, read back by the page reader, and digested.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. A null
    text is an empty one: one row of spaces. Equal texts give equal values; repeated rows stay; other
    columns are ignored. Storing, reading and digesting run in one worker, batch by batch.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda b: digest_batches(page_batches(media_batches(b), "media", ["doc_id", "n_bytes", "media"], WHOLE)), schema)
