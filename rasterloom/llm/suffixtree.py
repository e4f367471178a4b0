"""Language-model scores by a probabilistic suffix tree over bytes.

A text is its lower-cased words, each followed by a space, the last by the end mark. The tree keeps a
context of up to six bytes if it is seen twice and a divergence test at a thousandth says that its next-symbol
distribution differs from that of its suffix; suffixes of kept contexts are kept. A symbol's probability
is that of the longest kept suffix of its history, smoothed towards the suffix one byte shorter.

The tree grows with the corpus, so no process holds it whole. Its top, the contexts of fewer than SHARED
bytes, is bounded by the alphabet and goes to every bucket; a longer context belongs to the bucket of its
last SHARED bytes, with its suffixes and all their symbols. Batches ask buckets for their own grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path
from .exchange import by_batch, in_buckets, read_answer, stage_batches, write_answers
from .kernel import U64, Spans, lower, member, mix, pack_sorted, text_bytes, unpack_sorted, words

#: Bytes of the longest context; with its symbol it must leave a byte of a 64-bit key free.
DEPTH = 6
#: Symbols that a context must precede, whatever the corpus size.
LEAST = 2
#: Bytes that a context shares with all others of its bucket; shorter ones are known to every bucket.
SHARED = 3
#: Weight of the shorter context, in symbols.
PULL = 12.0
#: Normal quantile of the divergence test: of contexts whose symbols don't depend on the longer context, one in a thousand is kept.
QUANTILE = 3.0902
#: Bucket number of what makes up the tree's top.
TOP = -1
#: Key of the end token among the words' hashes.
END_WORD = U64(0xFFFFFFFFFFFFFFFE)
END = 10


def streams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with DEPTH end marks before each text, position of each text's first symbol, symbols of each text)."""
    start, end, upto = words(data, offsets)
    size = end - start
    count = np.diff(upto)
    letters = np.concatenate([[0], np.cumsum(size)])
    length = letters[upto[1:]] - letters[upto[:-1]] + np.maximum(count, 1)
    base = np.cumsum(length + DEPTH) - length
    out = np.full(int((length + DEPTH).sum()), END, np.uint8)
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(start)) - upto[row]
    to = base[row] + (letters[:-1] - letters[upto[row]]) + nth
    inner = np.arange(int(letters[-1])) - np.repeat(letters[:-1], size)
    out[np.repeat(to, size) + inner] = lower(data)[np.repeat(start, size) + inner]
    ends = to + size
    last = np.zeros(len(start), bool)
    last[upto[1:][count > 0] - 1] = True
    out[ends[~last]] = 32
    return out, base, length


def grams(out: np.ndarray, base: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each symbol with its DEPTH predecessors, the symbol in the lowest byte, text by text."""
    n = len(out) - DEPTH
    packed = np.zeros(max(0, n), U64)
    for k in range(DEPTH + 1):
        packed = packed << U64(8) | out[k : k + max(0, n)]
    at = np.arange(int(length.sum())) + np.repeat(base - DEPTH - (np.cumsum(length) - length), length)
    return packed[at]


def _suffix(gram: np.ndarray, size: int) -> np.ndarray:
    """The last size bytes."""
    return gram & U64((1 << 8 * size) - 1)


def _gram_counts(rb: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams with their counts, those of rows that aren't learned from with 0."""
    learn, out = rb.column("learn"), []
    for rows, weight in ((rb.filter(learn), 1), (rb.filter(pc.invert(learn)), 0)):
        kinds, n = np.unique(grams(*streams(*text_bytes(rows.column("text")))), return_counts=True)
        out.append((kinds, (n * weight).astype(np.float64)))
    return out


def _gram_bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return mix(_suffix(gram >> U64(8), SHARED)) % U64(buckets)


def levels(gram: np.ndarray, times: np.ndarray, depths: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (depth of the context, context and symbol, count) of the contexts of those depths that are seen often enough."""
    gram, times, rows = gram[times > 0], times[times > 0], []
    for d in depths:
        key, back = np.unique(_suffix(gram, d + 1), return_inverse=True)
        n = np.bincount(back, times, len(key))
        _, group = np.unique(key >> U64(8), return_inverse=True)
        often = (np.bincount(group, n) >= LEAST)[group] if len(key) else np.zeros(0, bool)
        rows.append((np.full(int(often.sum()), d), key[often], n[often]))
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True))


def likely(kinds: np.ndarray) -> np.ndarray:
    """The QUANTILE of chi-squared with so many degrees of freedom, by the cube-root approximation."""
    spread = 2 / (9 * np.maximum(kinds, 1))
    return kinds * (1 - spread + QUANTILE * np.sqrt(spread)) ** 3


class SuffixTree:
    """Kept contexts by depth, with their symbols' counts."""

    def __init__(self, depth: np.ndarray, gram: np.ndarray, times: np.ndarray):
        """Rows (depth of the context, context and symbol, count), see levels; with a context all its symbols and suffixes."""
        self.total = int(times[depth == 0].sum())
        self.keys, self.times, self.contexts, self.sums = [], [], [], []
        kept = np.zeros(1, U64)
        for d in range(DEPTH + 1):
            own = np.flatnonzero(depth == d)
            key, n = gram[own].astype(U64), times[own].astype(np.float64)
            order = np.argsort(key)
            key, n = key[order], n[order]
            context = key >> U64(8)
            first = np.flatnonzero(np.diff(context, prepend=U64(1 << 63)) != 0) if len(key) else np.zeros(0, np.int64)
            ids = context[first]
            sums = np.add.reduceat(n, first) if len(first) else n
            if d:
                self._push(ids, sums, key, n, first, d, kept)
            else:
                self.keys, self.times, self.contexts, self.sums = [key], [n], [ids], [sums]
            kept = self.contexts[-1]

    def _push(self, ids, sums, key, n, first, d, kept) -> None:
        """Adds depth d: contexts whose suffix is kept and whose symbols diverge from it."""
        group = np.repeat(np.arange(len(ids)), np.diff(np.append(first, len(key))))
        suffix = U64((1 << 8 * d) - 1)
        parent = self.probability(key & suffix, d - 1)
        gain = np.bincount(group, n * np.log(n / sums[group] / parent), len(ids)) if len(ids) else sums
        kinds = np.bincount(group, minlength=len(ids))
        test = 2 * gain > likely(kinds)  # about chi-squared with that mean if the symbols don't depend on the longer context
        test &= member(ids & U64((1 << 8 * (d - 1)) - 1), kept)[1] if d > 1 else True
        own = test[group] if len(ids) else np.zeros(0, bool)
        self.keys.append(key[own])
        self.times.append(n[own])
        self.contexts.append(ids[test] if len(ids) else ids)
        self.sums.append(sums[test] if len(ids) else sums)

    def probability(self, gram: np.ndarray, depth: int) -> np.ndarray:
        """P(symbol | its history) with contexts of up to `depth` bytes."""
        return self.walk(gram, depth)[0]

    def walk(self, gram: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(P(symbol | its history), bytes of the longest kept context) with contexts of up to `depth` bytes."""
        symbol = gram & U64(255)
        at, there = member(symbol, self.keys[0])
        p = (np.where(there, self.times[0][at] if len(self.keys[0]) else 0.0, 0.0) + 0.5) / (self.total + 128.0)
        live, reach = np.arange(len(gram)), np.zeros(len(gram), np.uint8)
        for d in range(1, depth + 1):
            code = gram[live] & U64((1 << 8 * (d + 1)) - 1)
            at, there = member(code >> U64(8), self.contexts[d])
            live, code, at = live[there], code[there], at[there]
            if not len(live):
                break
            k, seen = member(code, self.keys[d])
            reach[live] = d
            p[live] = (np.where(seen, self.times[d][k], 0.0) + PULL * p[live]) / (self.sums[d][at] + PULL)
        return p, reach


def _distinct(gram: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an example of each different probability's gram, which of them each gram has): it depends on the longest kept context alone."""
    whole = np.flatnonzero(reach == DEPTH)
    part = np.flatnonzero(reach < DEPTH)
    size = (reach[part].astype(U64) + U64(1)) * U64(8)
    code = gram[part] & ((U64(1) << size) - U64(1)) | size << U64(8 * DEPTH)
    _, first, back = np.unique(code, return_index=True, return_inverse=True)
    which = np.empty(len(gram), np.int64)
    which[part], which[whole] = back, len(first) + np.arange(len(whole))
    return np.concatenate([part[first], whole]), which


def learn_top(sent: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of contexts of fewer than SHARED bytes; their number is bounded by the alphabet."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for keys, n in zip(rb.column("keys"), rb.column("times"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpack_sorted(keys.as_py()).astype(np.int64)), pa.array(np.frombuffer(_plain(n), "<u4").astype(np.int64))], ["gram", "times"])

    whole = sent.where(F.col("bucket") == TOP).select("keys", "times").mapInArrow(run, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")).toArrow()
    return levels(whole.column("gram").to_numpy().astype(U64), whole.column("times").to_numpy().astype(np.float64), range(SHARED))


def _plain(blob: pa.Scalar) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob.as_py())


def _digest(keys: pa.Scalar) -> bytes:
    """Names a message: equal keys have equal answers."""
    return hashlib.sha1(keys.as_py()).digest()


def _answer_grams(top):
    """Per message the longest kept context of each of its grams and the log10 of each different probability, in 32 bits."""

    def run(sent: pa.Table) -> pa.Table:
        import zstandard

        held = []
        for b, t in zip(sent.column("keys"), sent.column("times"), strict=True):
            held.append((unpack_sorted(b.as_py()).byteswap(), np.frombuffer(_plain(t), "<u4")))
            if len(held) >= 32:
                held = [_added(held)]
        kinds, n = _added(held)
        del held
        tree = SuffixTree(*(np.concatenate(c) for c in zip(top.value, levels(kinds, n, range(SHARED, DEPTH + 1)), strict=True)))
        p, reach = tree.walk(kinds, DEPTH)
        value, squeeze, rows = np.log10(p).astype("<f4"), zstandard.ZstdCompressor(level=1).compress, []
        for b in sent.column("keys"):
            gram = unpack_sorted(b.as_py()).byteswap()
            at = member(gram, kinds)[0]
            rows.append((_digest(b), squeeze(reach[at].tobytes()), squeeze(value[at[_distinct(gram, reach[at])[0]]].tobytes())))
        return pa.table({"batch": sent.column("batch"), **{c: pa.array([r[j] for r in rows], pa.binary()) for j, c in enumerate(("message", "reach", "scores"))}})

    return run


def _word_keys(rb: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all rows, words before each row and in all)."""
    data, offsets = text_bytes(rb.column("text"))
    start, end, upto = words(data, offsets)
    return Spans(lower(data))(start, end), upto


def _word_counts(rb: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct words and the end with their counts in rows to learn from."""
    keys, upto = _word_keys(rb)
    learn = rb.column("learn").to_numpy(zero_copy_only=False)
    weight = np.append(np.repeat(learn, np.diff(upto)).astype(np.float64), learn.sum())
    kinds, back = np.unique(np.append(keys, END_WORD), return_inverse=True)
    return [(kinds, np.bincount(back, weight))]


def _word_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return key % U64(buckets)


def _send(buckets: int, counts: Callable, bucket_of: Callable, top: bool = False):
    """Each batch's distinct keys with their counts to the keys' buckets; with top also its gram's last SHARED bytes to TOP."""

    def flush(batch: int, held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        key, n = _added(held)
        bucket = bucket_of(key, buckets)
        if top:
            short = _added([(_suffix(key[n > 0], SHARED), n[n > 0])])
            key = key.byteswap()  # neighbours then end alike and compress well
            order = np.argsort(key)
            key, n, bucket = key[order], n[order], bucket[order]
        order = np.argsort(bucket, kind="stable")
        key, n, bucket = key[order], n[order], bucket[order]
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=U64(buckets))), len(key))
        rows = [(int(bucket[a]), batch, pack_sorted(key[a:b]), squeeze(n[a:b].astype("<u4").tobytes())) for a, b in zip(edges, edges[1:], strict=False)]
        if top:
            rows.append((TOP, batch, pack_sorted(short[0]), squeeze(short[1].astype("<u4").tobytes())))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "batch", "keys", "times"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch, rb in by_batch(rows):
            if batch != now:
                yield from flush(now, held)
                held, now = [], batch
            held += counts(rb)
            if len(held) >= 8:
                held = [_added(held)]
        yield from flush(now, held)

    return run


def _added(held: list) -> tuple[np.ndarray, np.ndarray]:
    kinds, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return kinds, np.bincount(back, np.concatenate([h[1] for h in held]))


def _answer_words(sent: pa.Table) -> pa.Table:
    """Per batch the corpus counts of its words; one row with batch -1 has the bucket's tokens and kinds."""
    keys = [unpack_sorted(b.as_py()) for b in sent.column("keys")]
    kinds, n = _added([(k, np.frombuffer(_plain(t), "<u4")) for k, t in zip(keys, sent.column("times"), strict=True)])
    n = n.astype(np.int64)
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    own = [squeeze(n[member(k, kinds)[0]].astype("<i8").tobytes()) for k in keys]
    blank = sent.column("keys").to_pylist()
    return pa.table({"batch": pa.array([*sent.column("batch").to_pylist(), -1], pa.int32()), "keys": pa.array([*blank, None], pa.binary()), "counts": pa.array([*own, None], pa.binary()), "tokens": pa.array([0] * len(keys) + [int(n.sum())], pa.int64()), "kinds": pa.array([0] * len(keys) + [int((n > 0).sum())], pa.int64())})


def _score(root: str, asked_root: str, gram_root: str, tokens: int, kinds: int):
    norm = np.log10(tokens + 0.5 * (kinds + 1))

    def merged(parts: list, kind: type) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, k) for j, k in ((0, U64), (1, kind)))
        order = np.argsort(key)
        return key[order], n[order]

    def word_answer(batch: int) -> tuple[np.ndarray, np.ndarray]:
        got = read_answer(root, batch)
        return merged([(unpack_sorted(b.as_py()), np.frombuffer(_plain(n), "<i8")) for b, n in zip(got.column("keys"), got.column("counts"), strict=True)] if got else [], np.int64)

    def gram_answer(batch: int) -> tuple[np.ndarray, np.ndarray]:
        asked, got, parts = read_answer(asked_root, batch), read_answer(gram_root, batch), []
        if asked and got:
            known = {m.as_py(): (r, v) for m, r, v in zip(*(got.column(c) for c in ("message", "reach", "scores")), strict=True)}
            for bucket, keys in zip(asked.column("bucket"), asked.column("keys"), strict=True):
                if bucket.as_py() != TOP:
                    reach, value = known[_digest(keys)]
                    gram = unpack_sorted(keys.as_py()).byteswap()
                    parts.append((gram, np.frombuffer(_plain(value), "<f4")[_distinct(gram, np.frombuffer(_plain(reach), np.uint8))[1]]))
        return merged(parts, np.float32)

    def log10(gram: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        each, back = np.unique(gram, return_inverse=True)
        at, there = member(each, model[0])
        assert there.all()
        return model[1][at].astype(np.float64)[back]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, model = None, None, None
        for batch, rb in by_batch(rows):
            if batch != now:
                known = model = None
                known, model, now = word_answer(batch), gram_answer(batch), batch
            keys, upto = _word_keys(rb)
            keys = np.append(keys, END_WORD)
            at, there = member(keys, known[0])
            n = np.where(there, known[1][at] if len(known[1]) else 0, 0)
            each = np.log10(n + 0.5) - norm
            total = lambda a: np.concatenate([[0], np.cumsum(a[:-1])])[upto]
            base = np.diff(total(each)) + each[-1]
            count, known_words = np.diff(upto) + 1, np.diff(total(n > 0)) + int(n[-1] > 0)
            out, first, length = streams(*text_bytes(rb.column("text")))
            borders = np.cumsum(length) - length
            score = np.add.reduceat(log10(grams(out, first, length), model), borders) if len(borders) else np.zeros(0)
            columns = [rb.column("doc_id"), rb.column("held_out"), *(pa.array(a.astype(np.int64)) for a in (count, known_words, np.full(len(count), tokens))), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """Scores rows (doc_id, text, held_out) by a tree and word counts learned from those not held out.

    Per row: doc_id, held_out, n_tokens (words and the end), n_known (tokens seen in training), train_tokens,
    base_score (smoothed unigrams of words, log10) and score (log10 of the tree's probability of the text's
    lower-cased words and end). A null or blank text is the end alone. Rows are independent, repeated ones
    repeat; an empty table gives none; other columns are ignored. Word counts and the tree are exact at any
    corpus size: a batch asks for its own words and grams, one entry each.
    """
    staged, n, buckets = stage_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", (~F.col("held_out")).alias("learn"), "text"), "lm")
    message = "bucket int, batch int, keys binary, times binary"
    asked_root = shared_path(staged.sparkSession, "grams")
    staged.select("_batch", "learn", "text").mapInArrow(_send(buckets, _gram_counts, _gram_bucket, True), message).write.partitionBy("batch").parquet(asked_root)
    asked = staged.sparkSession.read.schema(message).parquet(asked_root)
    top = staged.sparkSession.sparkContext.broadcast(learn_top(asked))
    gram_root = write_answers(in_buckets(asked.where(F.col("bucket") != TOP), _answer_grams(top), "batch int, message binary, reach binary, scores binary"), n, "gramscores")
    sent = staged.select("_batch", "learn", "text").mapInArrow(_send(buckets, _word_counts, _word_bucket), message)
    root = write_answers(in_buckets(sent, _answer_words, "batch int, keys binary, counts binary, tokens long, kinds long"), n, "words")
    spark = staged.sparkSession
    tokens, kinds = 0, 0
    if staged.take(1):
        sums = spark.read.schema("batch int, keys binary, counts binary, tokens long, kinds long").parquet(root).where("batch = -1").agg(F.sum("tokens"), F.sum("kinds")).first()
        tokens, kinds = sums[0] or 0, sums[1] or 0
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return staged.select("doc_id", "held_out", "_batch", "text").mapInArrow(_score(root, asked_root, gram_root, tokens, kinds), schema)
