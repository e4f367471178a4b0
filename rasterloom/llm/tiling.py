"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Tokens of a document and of a test item that share a seed (five tokens, or a shorter item whole) are tiled:
the longest common run of unmarked tokens is marked, then the next, down to a seed's length. The share of
the item that tiles cover is its coverage; the order of the tiles is free, so reordered passages count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fs, shared_path, texts
from .kernel import U64, Spans, member, mix

#: Least tokens of a tile and of a seed; an item with fewer is its own seed and tile.
SEED = 5
#: Least share of an item's tokens that tiles must cover.
COVERAGE = 0.6
#: Bytes of item texts that a worker holds; a larger benchmark is taken in as many blocks.
BLOCK_BYTES = 8 << 20
#: Scripts without spaces between words; each of their characters is a token.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORD = re.compile(f"[^\\W_{UNSPACED}]+|[{UNSPACED}]")
_BASE = U64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; of scripts without spaces, single characters."""
    return WORD.findall(text.lower())


def gram_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of each run of size ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, x = np.zeros(n, U64), mix(ids)
    for k in range(size):
        out = out * _BASE + x[k : k + n]
    return out


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of size unmarked tokens."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[size:] == total[:-size]) if len(marked) >= size else np.zeros(0, np.int64)


class Runner:
    """Hashes of token runs of any length, from prefix sums."""

    def __init__(self, ids: np.ndarray):
        self.spans = Spans(mix(ids), whole=True)

    def __call__(self, start: np.ndarray, size: int) -> np.ndarray:
        return self.spans(start, start + size)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, start in doc, start in item); id 0 matches nothing.

    Longest first, equal lengths by start in doc and then in item. Whether a common run of some length is left
    is a join of the runs' hashes; lengths never grow, so each next one is searched by halving below the last.
    Memory is linear in both, however often a run repeats.
    """
    used, done, out = doc == 0, item == 0, []
    of_doc, of_item = Runner(doc), Runner(item)

    def first(size: int) -> tuple[int, int] | None:
        at, of = _free(used, size), _free(done, size)
        if not len(at) or not len(of):
            return None
        table = of_item(of, size)
        order = np.argsort(table, kind="stable")
        where, there = member(of_doc(at, size), table[order])
        k = int(there.argmax())
        return (int(at[k]), int(of[order[where[k]]])) if there[k] else None

    size = min(len(doc), len(item))
    while size >= least:
        found, low = first(size), least
        if not found:
            best, high = None, size - 1
            while low <= high:
                mid = (low + high) // 2
                if got := first(mid):
                    best, size, low = got, mid, mid + 1
                else:
                    high = mid - 1
            if not (found := best):
                break
        i, j = found
        used[i : i + size] = done[j : j + size] = True
        out.append((size, i, j))
    return out


class Benchmark:
    """Items as token ids with the table of their seeds, by seed size; an item without a token can't be found."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        for item_id, text in items:
            words = words_of(text or "")
            if words:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        self.least = np.minimum([len(x) for x in self.items], seed).astype(np.int64)
        self.grams = [gram_hashes(x, int(n)) for x, n in zip(self.items, self.least, strict=True)]
        self.tables = {}
        for n in np.unique(self.least).tolist():
            own = np.flatnonzero(self.least == n)
            seeds = np.concatenate([np.unique(self.grams[k]) for k in own])
            of = np.repeat(own, [len(np.unique(self.grams[k])) for k in own])
            order = np.argsort(seeds, kind="stable")
            self.tables[n] = seeds[order], of[order]

    def hits(self, grams: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, seed) of the different seeds of that size that rows share with items, ordered."""
        seeds, of = self.tables[size]
        where = np.flatnonzero(member(grams, seeds)[1]) if len(grams) else np.zeros(0, np.int64)
        own, row = grams[where], row[where]
        order = np.lexsort((own, row))
        own, row = own[order], row[order]
        new = np.append(True, (own[1:] != own[:-1]) | (row[1:] != row[:-1]))[: len(own)]
        own, row = own[new], row[new]
        low, high = np.searchsorted(seeds, own, "left"), np.searchsorted(seeds, own, "right")
        n = high - low
        pick = of[np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)]
        row, own = np.repeat(row, n), np.repeat(own, n)
        order = np.lexsort((pick, row))
        return row[order], pick[order], own[order]


def write_items(benchmark: DataFrame) -> tuple[str, int]:
    """(folder, blocks) of the items, in the shared folder, one subfolder for a block of about BLOCK_BYTES of text."""
    items = benchmark.selectExpr("cast(item_id as long) item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, root = max(1, -(-size // BLOCK_BYTES)), shared_path(benchmark.sparkSession, "items")
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block").write.partitionBy("block").parquet(root)
    return root, blocks


_known: dict[tuple[str, int], Benchmark] = {}


def read_items(root: str, block: int) -> Benchmark:
    """A block of items, in a worker, which holds one at a time."""
    if (root, block) not in _known:
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        fs, path = arrow_fs(root)
        path = f"{path}/block={block}"
        there = fs.get_file_info(path).type != pafs.FileType.NotFound
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")] if there else []
        tables = [pq.read_table(f, filesystem=fs, partitioning=None) for f in sorted(files)]
        _known.clear()
        _known[root, block] = Benchmark([r for t in tables for r in zip(t.column("item_id").to_pylist(), t.column("text").to_pylist(), strict=True)])
    return _known[root, block]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a test item that it gives away.

    Per pair: doc_id, item_id, matched_tokens, item_tokens, coverage, n_tiles; only pairs whose tiles cover
    at least that share of the item. An item of fewer than five tokens is found where all of it stands; one
    without a token never is. A null or empty text matches nothing; repeated rows on either side give
    repeated pairs; empty tables give none. Only doc_id, text and item_id, text are read. Documents aren't
    shuffled: workers read the items from the shared folder, in blocks of BLOCK_BYTES of text, and
    documents are scanned once a block.
    """
    own, out = docs.selectExpr("cast(doc_id as long) doc_id", "text"), None
    root, blocks = write_items(benchmark)
    for block in range(blocks):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            memory = {}
            for batch in batches:
                found = leaks(read_items(root, block), texts(batch), coverage, memory)
                columns = [batch.column("doc_id").take(pa.array([r[0] for r in found], pa.int64()))]
                columns += [pa.array([r[j] for r in found], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()), (5, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "matched_tokens", "item_tokens", "coverage", "n_tiles"])

        part = own.mapInArrow(run, "doc_id long, item_id long, matched_tokens long, item_tokens long, coverage double, n_tiles long")
        out = part if out is None else out.unionAll(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows that give an item away; null and empty texts stay. See contaminated."""
    root, blocks = write_items(benchmark)
    for block in range(blocks):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            memory = {}
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[r[0] for r in leaks(read_items(root, block), texts(batch), coverage, memory)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def leaks(known: Benchmark, batch: list[str], least: float, memory: dict) -> list[tuple]:
    """(row, item id, matched tokens, item's tokens, coverage, tiles) of each text and item that it gives away."""
    get, ids, lengths = known.vocabulary.get, [], []
    for text in batch:
        own = [get(w, 0) for w in words_of(text)]
        ids += own
        ids += [0] * SEED
        lengths.append(len(own) + SEED)
    flat = np.array(ids, np.int64)
    starts, out = np.cumsum([0, *lengths]), []
    for size in known.tables:
        grams = gram_hashes(flat, size)
        place = np.searchsorted(starts, np.arange(len(grams)), "right") - 1
        row, of, seeds = known.hits(grams, place, size)
        edges = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(row)], strict=False):
            item, r = known.items[of[a]], int(row[a])
            if _reach(member(known.grams[of[a]], seeds[a:b])[1], size).sum() < least * len(item):
                continue
            own = grams[starts[r] : starts[r + 1] - size + 1]
            doc = _near(flat[starts[r] : starts[r + 1]], member(own, seeds[a:b])[1], size)
            key = (int(of[a]), doc.tobytes())
            if (got := memory.get(key)) is None:
                found = tiles(doc, item, size)
                if len(memory) > 5000:
                    memory.clear()
                got = memory[key] = (sum(t[0] for t in found), len(found))
            if got[0] >= least * len(item):
                out.append((r, known.ids[of[a]], got[0], len(item), got[0] / len(item), got[1]))
    return out


def _reach(seeds: np.ndarray, size: int) -> np.ndarray:
    """Which tokens lie in a run of size tokens that begins at one of the marks."""
    out = np.zeros(len(seeds) + size - 1, bool)
    for k in range(size):
        out[k : k + len(seeds)] |= seeds
    return out


def _near(doc: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """The document's tokens that lie in shared seeds, other stretches shrunk to one 0: tiles lie in seeds."""
    own = _reach(seeds, size)[: len(doc)]
    ids = np.where(own, doc, 0)
    return ids[own | np.concatenate([[True], own[:-1]])]
