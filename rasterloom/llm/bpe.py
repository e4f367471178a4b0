"""Byte-level BPE as a monoid: encodings of two halves are joined by re-encoding a window at their border.

A token sequence is the encoding of its bytes exactly when each token encodes to itself and every
adjacent pair of tokens is the encoding of its own bytes. Tokens of two encoded halves therefore stay
as they are, but for a window at the border; it grows until the pairs at its two edges hold. Decoding
is a homomorphism (bytes of a concatenation are the concatenation of bytes).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

#: Pieces up to this many bytes are leaves of the tree and merged directly.
LEAF = 8
#: Encodings of up to this many bytes are remembered: leaves and border windows repeat.
SHORT = 16
#: Ids of a leaf of decoding's tree.
LEAVES = 4096
#: Entries of each of a worker's caches; a full cache is emptied, which only costs time.
CACHE = 200_000
#: A space between two other non-space characters always begins a match of the pattern.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MonoidBPE:
    """Encodes and decodes with a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self._pair: dict[tuple[int, int], bool] = {}
        self._short: dict[bytes, list[int]] = {}

    def merge(self, b: bytes) -> list[int]:
        """The encoding of b, not as a tree; callers don't change it."""
        got = self._short.get(b)
        if got is None:
            got = self._merge(b)
            if len(b) <= SHORT:
                if len(self._short) >= CACHE:
                    self._short.clear()
                self._short[b] = got
        return got

    def _merge(self, b: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, until none is left."""
        ranks, n = self.ranks, len(b)
        if n == 1:
            return [ranks[b]]
        if n <= 4 * SHORT:
            parts = [b[i : i + 1] for i in range(n)]
            none = len(ranks) << 8
            pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(n - 1)]
            while pairs and (best := min(pairs)) < none:
                i = pairs.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
                if i:
                    pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            return [ranks[p] for p in parts]
        start, nxt, prv = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i] or (j := nxt[i]) >= n or end[j] != e:
                continue
            alive[j] = False
            end[i], nxt[i] = e, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := ranks.get(b[start[i] : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prv[i]) >= 0 and (r := ranks.get(b[start[p] : e])) is not None:
                heapq.heappush(heap, (r, p, e))
        return [ranks[b[start[i] : end[i]]] for i in range(n) if alive[i]]

    def holds(self, x: int, y: int) -> bool:
        """Whether the tokens x, y are the encoding of their bytes."""
        got = self._pair.get((x, y))
        if got is None:
            if len(self._pair) >= CACHE:
                self._pair.clear()
            got = self._pair[x, y] = self.merge(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
        return got

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The monoid's product: the encoding of decode(a) + decode(b)."""
        if not a or not b or self.holds(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            left, right = a[: len(a) - i], b[j:]
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, a[len(a) - i :] + b[:j])))
            fits_left = not left or self.holds(left[-1], window[0])
            fits_right = not right or self.holds(window[-1], right[0])
            if fits_left and fits_right:
                return left + window + right
            i = i if fits_left else min(len(a), 2 * i)
            j = j if fits_right else min(len(b), 2 * j)

    def tree(self, b: bytes) -> list[int]:
        """Encodes halves recursively and joins them."""
        if len(b) <= LEAF:
            return self.merge(b) if b else []
        mid = len(b) // 2
        return self.join(self.tree(b[:mid]), self.tree(b[mid:]))

    def encode_piece(self, b: bytes) -> list[int]:
        """Ids of one match of the pattern; a piece that is a token is that token."""
        r = self.ranks.get(b)
        return [r] if r is not None else self.tree(b)

    def decode(self, ids) -> bytes:
        """The bytes of ids, concatenated up a tree whose leaves are a few thousand ids."""
        if len(ids) <= LEAVES:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class TextEncoder:
    """Encodes whole texts: pieces by the pattern, ids packed as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: MonoidBPE, pattern: str):
        import regex

        self.bpe, self.pattern = bpe, regex.compile(pattern)
        self.rest = _Chunks(self, " ")

    def pack(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.bpe.encode_piece(piece.encode())
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Cuts at spaces where a match must begin, so chunks repeat and their ids are looked up."""
        if len(self.rest) >= CACHE:
            self.rest.clear()
        first, *others = SAFE_CUT.split(text)
        return self.pack(first) + b"".join(map(self.rest.__getitem__, others))


class _Chunks(dict):
    def __init__(self, encoder: TextEncoder, before: str):
        self.encoder, self.before = encoder, before

    def __missing__(self, chunk: str) -> bytes:
        packed = self.encoder.pack(self.before + chunk)
        if len(chunk) < 64:
            self[chunk] = packed
        return packed


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves where asked for.

    A null or empty text has no tokens (digests of the empty string). Every input row gives one output
    row, repeated ids and rows included; other columns of docs are ignored; an empty table gives none.
    A lone surrogate cannot occur in a Spark string. No shuffle: a narrow map over the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(bpe := MonoidBPE(load_ranks(ranks_path)), pattern)
        for batch in batches:
            n, sha, back, kept = [], [], [], []
            for text in texts(batch):
                packed = encoder(text)
                values = np.frombuffer(packed, "<u4").tolist()
                n.append(len(values))
                sha.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(bpe.decode(values)).hexdigest())
                if ids:
                    kept.append(values)
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out, names = [*out, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
