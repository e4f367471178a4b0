"""Token-id shards: fixed-width bit packing with a document index and block offsets.

A shard file, all little-endian: the magic b"RLTK", version u16, bits u16, documents u64, tokens u64,
ids a block u32, zero u32; then per document its id i64, a null flag u8 and its token count u64 as three
columns; then an offset u64 for each block (from the payload's start) and one at its end; then the
blocks. An id takes `bits` bits, least significant first, and a block begins on a byte.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fs, shared_path, together

MAGIC = b"RLTK"
HEAD = struct.Struct("<4sHHQQII")
#: Ids of a block, a multiple of 8; 8 ids always end on a byte.
BLOCK = 1 << 16
#: Entries of each generation of a worker's encoded words.
CACHE = 450_000


def bits_for(vocabulary: int) -> int:
    """The least width that holds every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = ids.astype("<u4")[:, None].view(np.uint8)
    return np.packbits(np.unpackbits(planes, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first count ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    full = np.zeros((count, 32), np.uint8)
    full[:, :bits] = flat
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Collects documents in order; packs a block whenever one is full."""

    def __init__(self, bits: int):
        self.bits, self.ids, self.counts = bits, [], []
        self.rest, self.waiting, self.blocks, self.tokens = [], 0, [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.tokens += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 4 * BLOCK:
            self._pack(self.waiting // BLOCK)

    def _pack(self, blocks: int) -> None:
        whole = np.concatenate(self.rest)
        self.blocks += [pack(whole[k * BLOCK : (k + 1) * BLOCK], self.bits) for k in range(blocks)]
        self.rest = [whole[blocks * BLOCK :]]
        self.waiting = len(self.rest[0])

    def write(self, f) -> None:
        if self.waiting:
            self._pack(-(-self.waiting // BLOCK))
        f.write(HEAD.pack(MAGIC, 1, self.bits, len(self.ids), self.tokens, BLOCK, 0))
        f.write(np.array([i or 0 for i in self.ids], "<i8").tobytes())
        f.write(np.array([i is None for i in self.ids], np.uint8).tobytes())
        f.write(np.array(self.counts, "<u8").tobytes())
        f.write(np.cumsum([0, *map(len, self.blocks)], dtype="<u8").tobytes())
        for b in self.blocks:
            f.write(b)


class ShardReader:
    """Random access to a shard: the index is read at once, blocks when asked for."""

    def __init__(self, f):
        self.f = f
        magic, version, self.bits, docs, self.tokens, self.block, _ = HEAD.unpack(f.read(HEAD.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        column = lambda kind, n: np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)
        self.ids, self.null, self.counts = column("<i8", docs), column(np.uint8, docs), column("<u8", docs).astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.offsets = column("<u8", -(-self.tokens // self.block) + 1).astype(np.int64)
        self.payload = f.tell()
        self.held = (-1, np.zeros(0, np.uint32))

    def _block(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            self.f.seek(self.payload + int(self.offsets[k]))
            self.held = (k, unpack(self.f.read(int(self.offsets[k + 1] - self.offsets[k])), self.bits, min(self.block, self.tokens - k * self.block)))
        return self.held[1]

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids at positions start to end of the shard."""
        parts = [self._block(k)[max(0, start - k * self.block) : end - k * self.block] for k in range(start // self.block, -(-end // self.block) if end > start else 0)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self.slice(int(self.ends[i] - self.counts[i]), int(self.ends[i]))


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases and never joins across white space, remembering words.

    Arrow splits at spaces and line feeds, numbers a batch's different words and lower-cases those that are
    ASCII alone (the tokenizer composes characters before it lower-cases, so a mark may join a capital), so
    Python meets each of them once a batch. An end of ASCII marks is cut off a word of letters, which the
    tokenizer would do as well. Words not seen yet go to the library together; words of letters are joined by
    spaces and told apart by the end-of-word mark of their last token, if there is exactly one mark a word.
    Texts that hold an added token (`<|endoftext|>`) go to the library whole. The memory has two generations:
    when the young one is full it becomes the old one, and words in use move back.
    """

    MARKS = "".join(c for c in string.punctuation if c != "'")
    JOINED = 256

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.last = np.zeros(self.vocabulary, bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        #: Added tokens stand for themselves in any text, in their exact case.
        self.markers = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _letters(word: str) -> bool:
        return word.lower().isalpha() and unicodedata.is_normalized("NFC", word)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4")

    def _encode_words(self, words: list[str]) -> None:
        """Words of letters alone."""
        groups = [words[k : k + self.JOINED] for k in range(0, len(words), self.JOINED)]
        odd = []
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group):
                odd += group
                continue
            packed, at = ids.tobytes(), 0
            for w, end in zip(group, (ends * 4).tolist(), strict=True):
                self.known[w] = packed[at:end]
                at = end
        self.known.update((w, ids.tobytes()) for w, ids in zip(odd, self._encode(odd), strict=True))

    def _learn(self, words: list[str]) -> None:
        known, old = self.known, self.old
        known.update((w, old[w]) for w in words if w in old)
        words = [w for w in words if w not in known]
        ended = {w: len(body) for w in words if 0 < len(body := w.rstrip(self.MARKS)) < len(w) and self._letters(body)}
        new = {part for w in words for part in ((w[: ended[w]], w[ended[w] :]) if w in ended else (w,)) if part not in known}
        plain = [w for w in new if self._letters(w)]
        other = list(new.difference(plain))
        self._encode_words(plain)
        known.update((w, ids.tobytes()) for w, ids in zip(other, self._encode(other), strict=True))
        for w, n in ended.items():
            known[w] = known[w[:n]] + known[w[n:]]

    def _words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As a call, for texts without an added token."""
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(column, ""), "\n", " "), " ")
        ends = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)))
        coded = split.flatten().dictionary_encode()
        plain = pc.string_is_ascii(coded.dictionary)
        if self.markers:  # in another case it is no added token, and must not become one
            plain = pc.and_(plain, pc.invert(pc.match_substring_regex(coded.dictionary, f"(?i){self.markers}")))
        words = pc.if_else(plain, pc.ascii_lower(coded.dictionary), coded.dictionary).to_numpy(zero_copy_only=False).tolist()
        self._learn(list({w: None for w in words if w not in self.known}))
        packed = [self.known[w] for w in words]
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts, flat, at = np.cumsum(size) - size, np.frombuffer(b"".join(packed), "<u4"), coded.indices.to_numpy()
        count = size[at]
        before = np.append(0, np.cumsum(count))
        ids = flat[np.repeat(starts[at] - before[:-1], count) + np.arange(before[-1])]
        return ids, np.diff(before[ends])


    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of a string column's texts, one text after another; each text's count of ids); null is empty."""
        has = pc.fill_null(pc.match_substring_regex(column, self.markers), False).to_numpy(zero_copy_only=False) if self.markers else np.zeros(len(column), bool)
        if not has.any():
            return self._words(column)
        ids, counts = self._words(column.filter(pa.array(~has)))
        rest, whole = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []), self._encode(column.filter(pa.array(has)).to_pylist())
        rows = [next(whole if h else rest) for h in has]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder; it and what it remembers outlast a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, root: str) -> list[dict]:
    """Encodes docs in ascending doc_id order into one shard file a partition below root; gives the manifest.

    One shuffle: a range partitioning by doc_id and the text's hash, so that rows of one id or of none are split too. A task writes its own file name and
    reports it when done, so files of failed or repeated attempts are never read. The manifest has one
    entry a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode = word_encoder(tokenizer_path)
        shard = ShardWriter(bits_for(max(encode.vocabulary, end_id + 1)))
        for batch in together(batches, 1000, 4 << 20):  # a word's turn comes once in each
            ids, counts = encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), np.split(ids, (ends + np.arange(1, len(ends) + 1))[:-1]), strict=True):
                shard.add(doc_id, own)
        if not shard.ids:
            return
        fs, path = arrow_fs(root)
        fs.create_dir(path, recursive=True)
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.rltk"
        with fs.open_output_stream(f"{path}/{name}") as f:
            shard.write(f)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([len(shard.ids)], pa.int64()), pa.array([shard.tokens], pa.int64())], ["part", "name", "docs", "tokens"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumn("hash", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("hash")
    rows = sorted(ordered.mapInArrow(run, "part int, name string, docs long, tokens long").collect(), key=lambda r: r.part)
    manifest, at = [], 0
    for r in rows:
        manifest.append({"name": r.name, "docs": r.docs, "tokens": r.tokens, "start": at})
        at += r.tokens
    return manifest


def read_shards(spark, root: str, manifest: list[dict]) -> DataFrame:
    """Per document of the shards, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = arrow_fs(root)
        for batch in batches:
            for entry in map(json.loads, batch.column("entry").to_pylist()):
                with fs.open_input_file(f"{path}/{entry['name']}") as f:
                    shard = ShardReader(f)
                    for a in range(0, len(shard.ids), 2000):
                        rows = range(a, min(a + 2000, len(shard.ids)))
                        crc = [zlib.crc32(shard.document(i).astype("<u4").tobytes()) for i in rows]
                        own = slice(rows.start, rows.stop)
                        columns = [pa.array(shard.ids[own], mask=shard.null[own] > 0), pa.array(entry["start"] + (shard.ends - shard.counts)[own]), pa.array(shard.counts[own]), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    entries = spark.createDataFrame([(json.dumps(m),) for m in manifest], "entry string")
    return entries.repartition(max(1, len(manifest))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenise_to_shards(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes docs as token shards to the shared folder and reads them back.

    Per document: doc_id, start (ids of all documents before it), n_tokens with the end id, ids_crc32. A
    null or empty text is the end id alone. Rows of equal doc_id are ordered by their texts' hash; null ids come first.
    An empty table gives no files and no rows; other columns are ignored.
    """
    root = shared_path(docs.sparkSession, "shards")
    return read_shards(docs.sparkSession, root, write_shards(docs, tokenizer_path, end_id, root))
