"""Repeated passages by merging the Burrows-Wheeler transforms of shards.

A collection of strings, each padded and taken as a circle, is sorted shard by shard, to the depth of a window.
Shard orders are merged by interleave refinement: the interleave after k rounds is right for the first g*k symbols,
and a round deals the shards' BWT symbols (g preceding bytes each) stably into their classes, which moves every
shard's ranks one LF step without touching a suffix. Each border between neighbours carries the round that made it
and so their common prefix; the intervals between borders shorter than a window are its repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .exchange import by_batch, in_buckets, read_answer, stage_batches, write_answers
from .kernel import U64, Spans, member, pack_sorted, text_bytes, unpack_sorted

#: Bytes of a string that counts as repeated.
WINDOW = 50
#: Bytes of the grams that anchor windows: each window is owned by its least gram.
GRAM = 20
#: Windows of one context at most (a bit each); longer runs, which only periodic text has, are cut.
RUN = 32
#: Places of an anchor in all rows beyond which each of its windows travels by itself, to the bucket of its own hash.
HOT = 4096
#: Bytes of strings that are merged together, about, so few that codes of ten bytes fit 16 bits; one anchor's are at
#: most HOT times the longest context.
CHUNK = 50_000
SHARDS = 4


def gram_codes(data: np.ndarray, nxt: np.ndarray) -> tuple[int, np.ndarray]:
    """(g, code of the g bytes from each position along nxt), g as large as codes fit 16 bits; g divides WINDOW."""
    at, packed, two = np.arange(len(data)), np.zeros(len(data), U64), None
    for k in range(5):
        packed = packed << U64(8) | data[at]
        at = nxt[at]
        if k == 1:
            two = packed.astype(np.uint16)
    kinds, codes = np.unique(packed, return_inverse=True)
    if len(kinds) > 1 << 16:
        return 2, two
    codes = codes.astype(np.uint32)
    kinds, longer = np.unique(codes << np.uint32(16) | codes[at], return_inverse=True)
    return (10, longer.astype(np.uint16)) if len(kinds) <= 1 << 16 else (5, codes.astype(np.uint16))


def shard_order(codes: np.ndarray, back: np.ndarray, rounds: int) -> np.ndarray:
    """Positions of a shard's circles sorted by as many codes, a stable round each."""
    order = np.arange(len(codes))
    for _ in range(rounds):
        order = back[order]
        order = order[np.argsort(codes[order], kind="stable")]
    return order


def merge_bwts(bwts: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of sorted shards from their BWTs alone, to that many rounds.

    Gives, along the merged order, the shard and the common prefix with the one before: the rounds, in units of g,
    that the two are equal for, which is `rounds` if nothing parted them.
    """
    symbols = np.concatenate(bwts)
    shard = np.repeat(np.arange(len(bwts), dtype=np.uint8), [len(b) for b in bwts])
    group, common, borders = np.zeros(len(symbols), np.int32), np.full(len(symbols), rounds, np.uint8), 0
    for k in range(rounds):
        merged = np.empty_like(symbols)
        merged[np.argsort(shard, kind="stable")] = symbols
        deal = np.argsort(merged, kind="stable")
        shard, merged, before = shard[deal], merged[deal], group[deal]
        border = np.empty(len(symbols), bool)
        border[:1] = True
        border[1:] = (merged[1:] != merged[:-1]) | (before[1:] != before[:-1])
        np.minimum(common, k, out=common, where=border)
        group = np.cumsum(border, dtype=np.int32)
        if len(group) and group[-1] == borders:  # no new border: later rounds find none either
            break
        borders = int(group[-1]) if len(group) else 0
    return shard, common


def repeat_minimum(strings: np.ndarray, lengths: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each 50-byte window of distinct strings, in order: the least weight of a string that holds it."""
    count, starts = len(lengths), np.cumsum(lengths) - lengths
    pad = 5
    size = lengths + pad
    base = np.cumsum(size) - size
    total = int(size.sum())
    data = np.zeros(total, np.uint8)
    inner = np.arange(len(strings)) + np.repeat(base - starts, lengths)
    data[inner] = strings
    owner = np.repeat(np.arange(count), size)
    nxt = np.arange(1, total + 1)
    nxt[base + size - 1] = base
    g, codes = gram_codes(data, nxt)
    back = np.arange(total) - g
    wrap = np.arange(total) - base[owner] < g
    back[wrap] += size[owner[wrap]]
    cuts = np.searchsorted(base, np.linspace(0, total, min(SHARDS, count) + 1)[1:-1])
    edges = [0, *dict.fromkeys(int(base[c]) for c in cuts if 0 < c < count), total]
    orders, bwts = [], []
    for lo, hi in zip(edges, edges[1:], strict=False):
        order = shard_order(codes[lo:hi], back[lo:hi] - lo, WINDOW // g) + lo
        orders.append(order)
        bwts.append(codes[back[order]])
    shard, common = merge_bwts(bwts, WINDOW // g)
    position = np.empty(total, np.int64)
    position[np.argsort(shard, kind="stable")] = np.concatenate(orders)
    inside = position - base[owner[position]]
    usable = inside <= lengths[owner[position]] - WINDOW
    group = np.cumsum(common * g < WINDOW)  # a shorter common prefix begins the next interval
    position, group = position[usable], group[usable]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(weight[owner[position]], first) if len(first) else weight[:0]
    out = np.empty(total, weight.dtype)
    out[position] = np.repeat(least, np.diff(np.append(first, len(position))))
    windows = lengths - WINDOW + 1
    at = np.arange(int(windows.sum())) + np.repeat(base - (np.cumsum(windows) - windows), windows)
    return out[at]


class Contexts:
    """Runs of windows that share an anchor: start, windows, anchor key (48 bits), hash of the bytes, row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashes: bool = True):
        n = len(data) - WINDOW + 1
        if n <= 0:
            self.start = self.windows = self.row = np.zeros(0, np.int64)
            self.key = self.hash = np.zeros(0, U64)
            return
        spans = Spans(data)
        end = len(data) - GRAM + 1
        least = (spans.sums[GRAM:] - spans.sums[:end]) * spans.down[:end]
        least ^= least >> U64(29)
        least *= U64(0xBF58476D1CE4E5B9)
        least ^= least >> U64(32)
        span = 1
        while span < WINDOW - GRAM + 1:
            step = min(span, WINDOW - GRAM + 1 - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        starts = offsets[:-1]
        whole = np.zeros(n + 1, np.int8)
        long = np.diff(offsets) >= WINDOW
        whole[starts[long]] += 1
        whole[offsets[1:][long] - WINDOW + 1] -= 1
        inside = np.cumsum(whole[:n], dtype=np.int8) > 0
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        new[starts[starts < n]] = True
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, n))
        keep = inside[at]
        at, count = at[keep], count[keep]
        if len(count) and count.max() > RUN:
            parts = -(-count // RUN)
            k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            at, count = np.repeat(at, parts) + RUN * k, np.minimum(np.repeat(count, parts) - RUN * k, RUN)
        self.start, self.windows = at, count
        self.key = least[at] >> U64(16)
        self.row = np.searchsorted(offsets, at, "right") - 1
        self.spans = spans
        self.hash = spans(at, at + count + WINDOW - 1) if hashes else None

    def keep(self, those: np.ndarray) -> None:
        for name in ("start", "windows", "key", "row", "hash"):
            setattr(self, name, getattr(self, name)[those])

    def divide(self, hot: np.ndarray) -> None:
        """Runs at anchors among hot become a run for each window, with its own hash as key."""
        if not len(self.key) or not len(hot):
            return
        split = np.flatnonzero(member(self.key, hot)[1])
        n = self.windows[split]
        at = np.repeat(self.start[split], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        own = self.spans(at, at + WINDOW)
        rest = np.ones(len(self.key), bool)
        rest[split] = False
        order = np.argsort(np.concatenate([self.start[rest], at]), kind="stable")
        pairs = {"start": at, "windows": np.ones(len(at), np.int64), "key": own >> U64(16), "row": np.repeat(self.row[split], n), "hash": own}
        for name, new in pairs.items():
            setattr(self, name, np.concatenate([getattr(self, name)[rest], new])[order])


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _key_extent(key: np.ndarray, low: np.ndarray, high: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys with their least and greatest id and their places."""
    order = np.argsort(key, kind="stable")
    key, low, high, times = key[order], low[order], high[order], times[order]
    first = _runs(key)
    return (key[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.add.reduceat(times, first)) if len(first) else (key, low, high, times)


def _send_anchors(buckets: int, most: int):
    import zstandard

    def flush(batch: int, held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, low, high, times = _key_extent(*(np.concatenate(x) for x in zip(*held, strict=True)))
        bucket = key % U64(buckets)
        order = np.argsort(bucket, kind="stable")
        key, bucket, many, times = key[order], bucket[order], (low != high)[order], np.minimum(times, most + 1).astype("<u2")[order]
        edges, squeeze = np.append(_runs(bucket), len(key)), zstandard.ZstdCompressor(level=1).compress
        rows = [(int(bucket[a]), batch, pack_sorted(key[a:b]), pack_sorted(key[a:b][many[a:b]]), squeeze(times[a:b].tobytes())) for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "batch", "keys", "many", "times"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch, rb in by_batch(rows):
            if batch != now:
                yield from flush(now, held)
                held, now = [], batch
            c = Contexts(*text_bytes(rb.column("text")), hashes=False)
            ids = rb.column("_ord").to_numpy()[c.row]
            held.append(_key_extent(c.key, ids, ids, np.ones(len(ids), np.uint32)))
            if len(held) >= 16:
                held = [_key_extent(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        yield from flush(now, held)

    return run


def _answer_anchors(most: int):
    """Per batch: which of its anchors several ids hold, and which of them have more than `most` places."""

    def run(sent: pa.Table) -> pa.Table:
        import zstandard

        keys = [unpack_sorted(b.as_py()) for b in sent.column("keys")]
        every, back, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = every[times > 1]
        for b in sent.column("many"):
            if len(many := unpack_sorted(b.as_py())):
                shared = np.union1d(shared, many)
        places = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(t.as_py()), "<u2") for t in sent.column("times")])
        hot = np.intersect1d(every[np.bincount(back, places, len(every)) > most], shared, assume_unique=True)
        return pa.table({"batch": sent.column("batch"), **{name: pa.array([pack_sorted(k[member(k, of)[1]]) for k in keys], pa.binary()) for name, of in (("keys", shared), ("hot", hot))}})

    return run


def _keys_of(root: str, batch: int, column: str) -> np.ndarray:
    """Anchors of a batch as answered: `keys`, the shared ones, or `hot`."""
    answer = read_answer(root, batch, [column])
    return np.sort(np.concatenate([unpack_sorted(b.as_py()) for b in answer.column(column)])) if answer else np.zeros(0, U64)


#: Bytes of contexts that a task holds before it sends them on.
HELD = 24 << 20


def _send_contexts(buckets: int, root: str):
    import zstandard

    names = ["bucket", "batch", "hash", "key", "ord", "windows", "bytes"]

    def flush(batch: int, held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        hashes, key, ids, windows = (np.concatenate([h[j] for h in held]) for j in range(4))
        data = np.concatenate([h[4] for h in held])
        size = windows.astype(np.int64) + WINDOW - 1
        at = np.cumsum(size) - size
        order = np.lexsort((ids, hashes))
        order = order[_runs(hashes[order])]
        bucket = key[order] % U64(buckets)
        by = np.argsort(bucket, kind="stable")
        order, bucket = order[by], bucket[by]
        edges = np.append(_runs(bucket), len(order))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        rows = []
        for a, b in zip(edges, edges[1:], strict=False):
            o = order[a:b]
            pick = np.arange(int(size[o].sum())) + np.repeat(at[o] - (np.cumsum(size[o]) - size[o]), size[o])
            rows.append((int(bucket[a]), batch, hashes[o].tobytes(), key[o].tobytes(), ids[o].tobytes(), windows[o].tobytes(), squeeze(data[pick].tobytes())))
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[k : k + 64]], t) for j, t in enumerate(types)], names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, shared, hot, size = [], None, None, None, 0
        for batch, rb in by_batch(rows):
            if batch != now or size > HELD:
                yield from flush(now, held)
                if batch != now:
                    shared, hot = _keys_of(root, batch, "keys"), _keys_of(root, batch, "hot")
                held, now, size = [], batch, 0
            if not len(shared):
                continue
            data, offsets = text_bytes(rb.column("text"))
            c = Contexts(data, offsets)
            c.keep(member(c.key, shared)[1])
            c.divide(hot)
            hit = np.arange(len(c.key))
            ids = rb.column("_ord").to_numpy()[c.row[hit]]
            order = np.lexsort((ids, c.hash[hit]))
            order = order[_runs(c.hash[hit][order])]
            o, ids = hit[order], ids[order]
            length = c.windows[o] + WINDOW - 1
            pick = np.arange(int(length.sum())) + np.repeat(c.start[o] - (np.cumsum(length) - length), length)
            held.append((c.hash[o], c.key[o], ids, c.windows[o].astype(np.uint8), data[pick]))
            size += len(pick)
        yield from flush(now, held)

    return run


def _answer_contexts(sent: pa.Table) -> pa.Table:
    """Per batch: for each of its contexts, its own least id and a bit per window that a smaller id holds too."""
    import zstandard

    sizes = [len(b.as_py()) // 8 for b in sent.column("hash")]
    whole = lambda name, kind: np.frombuffer(b"".join(sent.column(name).to_pylist()), kind)
    hashes, key, ids, windows = whole("hash", "<u8"), whole("key", "<u8"), whole("ord", "<i8"), whole("windows", np.uint8).astype(np.int64)
    data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(b) for b in sent.column("bytes").to_pylist()), np.uint8)
    size = windows + WINDOW - 1
    at = np.cumsum(size) - size
    order = np.lexsort((ids, hashes))
    first = _runs(hashes[order])
    kinds, least = order[first], ids[order[first]]
    kind_of = np.empty(len(hashes), np.int64)
    kind_of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    floor = np.repeat(least[:, None], RUN, 1)
    most = np.maximum.reduceat(ids[order], first) if len(first) else least
    by_key = np.argsort(key[kinds], kind="stable")
    edges = np.append(_runs(key[kinds][by_key]), len(by_key))
    # an anchor whose strings one id holds alone, as parts of hot ones may be, has nothing to remove
    low, high = (f.reduceat(a[by_key], edges[:-1]) if len(by_key) else a for f, a in ((np.minimum, least), (np.maximum, most)))
    rival = np.flatnonzero(low < high)
    k = 0
    while k < len(rival):
        group, held = [], 0
        while k < len(rival) and (not group or held < CHUNK):
            own = by_key[edges[rival[k]] : edges[rival[k] + 1]]
            group.append(own)
            held += int(size[kinds[own]].sum())
            k += 1
        own = np.concatenate(group)
        src = kinds[own]
        pick = np.arange(held) + np.repeat(at[src] - (np.cumsum(size[src]) - size[src]), size[src])
        found = repeat_minimum(data[pick], size[src], least[own])
        w = windows[src]
        floor[np.repeat(own, w), np.arange(len(found)) - np.repeat(np.cumsum(w) - w, w)] = found
    mask = np.zeros(len(hashes), np.uint32)
    for j in range(RUN):
        mask |= (floor[kind_of, j] < ids).astype(np.uint32) << np.uint32(j)
    cut = np.cumsum([0, *sizes])
    parts = list(zip(cut, cut[1:], strict=False))
    return pa.table({"batch": sent.column("batch"), **{n: pa.array([a[x:y].tobytes() for x, y in parts], pa.binary()) for n, a in (("hash", hashes), ("ord", ids), ("mask", mask))}})


def _mark(root: str, anchors: str, with_text: bool):
    """Rereads batches with their answers and removes the repeated bytes."""

    def answer(batch: int):
        got = read_answer(root, batch)
        if not got:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        hashes, ids, mask = (np.frombuffer(b"".join(got.column(n).to_pylist()), k) for n, k in (("hash", "<u8"), ("ord", "<i8"), ("mask", "<u4")))
        order = np.lexsort((ids, hashes))
        order = order[_runs(hashes[order])]
        return hashes[order], ids[order], mask[order]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, hot = None, None, None
        for batch, rb in by_batch(rows):
            if batch != now:
                known, hot, now = answer(batch), _keys_of(anchors, batch, "hot"), batch
            data, offsets = text_bytes(rb.column("text"))
            gone = np.zeros(len(data), bool)
            if len(known[0]):
                c = Contexts(data, offsets)
                c.divide(hot)
                at, there = member(c.hash, known[0])
                hit = np.flatnonzero(there)
                at, n = at[hit], c.windows[hit]
                bit = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                ids = rb.column("_ord").to_numpy()[c.row[hit]]
                flag = np.repeat(ids != known[1][at], n) | ((np.repeat(known[2][at], n) >> bit.astype(np.uint32)) & np.uint32(1) > 0)
                start = (np.repeat(c.start[hit], n) + bit)[flag]
                cover = np.zeros(len(data) + 1, np.int32)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + WINDOW, -1)
                gone = np.cumsum(cover[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            opens[inner] = gone[inner]
            upto = lambda a: np.concatenate([[0], np.cumsum(a)])[offsets]
            removed, spans = np.diff(upto(gone)), np.diff(upto(opens))
            kept = [data[a:b][~gone[a:b]].tobytes() if r else data[a:b].tobytes() for a, b, r in zip(offsets[:-1], offsets[1:], removed, strict=True)]
            columns = [rb.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                rest = [n for n in rb.schema.names if n.startswith("carry ")]
                columns += [pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), *(rb.column(n) for n in rest)]
                names += ["text", *rest]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """Removes each byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with carry (names of further columns of
    docs, e.g. []), also text, the bytes left over with broken characters dropped, and those columns.
    A null or text shorter than 50 bytes keeps all its bytes. Rows of equal doc_id are not smaller than
    one another, so they don't remove each other's text; a null doc_id counts as the smallest id. An empty
    table gives no rows; other columns are ignored and never clash.

    Only windows whose anchor occurs in two ids travel: as distinct contexts a batch, to the bucket of
    their anchor, where equal contexts are one string of its least id, and shard BWTs of each shared
    anchor's strings are merged. Windows of an anchor with more than `hot` places go by their own hash, so
    that no bucket gathers a frequent gram's surroundings. Work and shuffled bytes grow with the text.
    """
    with_text = carry is not None
    carry = carry or []
    least_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    staged, n, buckets = stage_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), least_id.alias("_ord"), "text", *(F.col(f"`{c}`").alias(f"carry {i}") for i, c in enumerate(carry))), "repeats")
    slim = staged.select("_batch", "_ord", "text")
    tidy(docs.sparkSession)
    anchors = slim.mapInArrow(_send_anchors(buckets, hot), "bucket int, batch int, keys binary, many binary, times binary")
    shared = write_answers(in_buckets(anchors, _answer_anchors(hot), "batch int, keys binary, hot binary"), n, "anchors")
    contexts = slim.mapInArrow(_send_contexts(2 * buckets, shared), "bucket int, batch int, hash binary, key binary, ord binary, windows binary, bytes binary")
    marks = write_answers(in_buckets(contexts, _answer_contexts, "batch int, hash binary, ord binary, mask binary"), n, "marks")
    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if with_text else "") + "".join(f", `carry {i}` {kinds[c]}" for i, c in enumerate(carry))
    marked = (staged if with_text else staged.select("doc_id", "_batch", "_ord", "text")).mapInArrow(_mark(marks, shared, with_text), schema)
    return marked.toDF(*marked.columns[: len(marked.columns) - len(carry)], *carry)
