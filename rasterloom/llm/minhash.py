"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union.

SuperMinHash spreads each element's values over the whole signature by one random permutation, so the
components are negatively correlated and the variance is lower than that of independent permutations;
an element stops as soon as its next value can't lower the signature any more.

Documents that share a band are candidates. Links are first confirmed along stars: every candidate with
its band's hub, the document whose bands are fullest, then those that are in no band's largest component with
some of its members. What stars connect is one component; only pairs across components are looked at further,
and none inside a band's largest one. There set sizes rule pairs out, then a parity sketch's lower bound of the
sets' difference, exactly; the pairs left are confirmed on full sets.
"""

from __future__ import annotations

import atexit
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, restage, stage
from .exchange import by_batch, read_answer, stage_batches, without, write_answers
from .kernel import U64, Spans, lower, mix, text_bytes, words

SHINGLE = 5
#: Links need percent * union <= 100 * intersection; this one unless the caller says otherwise.
PERCENT = 85
#: A link of that similarity is missed by all bands with a chance of (1 - 0.85**4)**20, under 1 in 2 million; at 0.8 it is 3 in 100,000.
BANDS, ROWS = 20, 4
#: Bits of a parity sketch.
SKETCH = 2048
#: Members of a band that are compared with as many others in one task; larger bands are cut into such blocks.
BLOCK = 256
#: Rows of tasks that are compared at once.
TOGETHER = 4096
#: Members of a band's largest component that its other members are compared with first.
HUBS = 8
_PLACE = mix(np.arange(1, SHINGLE + 1, dtype=U64)) | U64(1)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 64-bit shingle hashes of all rows, ascending in each row; the n + 1 row borders)."""
    data, offsets = text_bytes(column)
    data = lower(data)
    start, end, upto = words(data, offsets)
    if not len(start):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    w = Spans(data)(start, end)
    count = np.diff(upto)
    row = np.repeat(np.arange(len(count)), count)
    n = len(w) - shingle + 1
    h, own = np.zeros(0, U64), np.zeros(0, np.int64)
    if n > 0:
        inside = np.flatnonzero(row[:n] == row[shingle - 1 :])
        h, own = np.zeros(len(inside), U64), row[inside]
        for k in range(shingle):
            h += w[inside + k] * _PLACE[k]
    few = np.flatnonzero((count > 0) & (count < shingle))
    if len(few):
        short = np.zeros(len(few), U64)
        for k in range(shingle - 1):
            has = count[few] > k
            short[has] += w[upto[few[has]] + k] * _PLACE[k]
        short += count[few].astype(U64) * U64(0xD6E8FEB86659FD93)
        h, own = np.concatenate([h, short]), np.concatenate([own, few])
    h = mix(h)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.searchsorted(own[new], np.arange(len(count) + 1))


def super_minhash(h: np.ndarray, borders: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (rows x size) of the sets between borders; an empty set keeps the largest value.

    Step j gives each element one value in [j, j + 1) at the j-th place of its own permutation. A set is
    done when no component exceeds j + 1, and the permutations are only made from the second step on.
    """
    count = np.diff(borders)
    out = np.full((len(count), size), np.iinfo(U64).max, U64)
    row = np.repeat(np.arange(len(count)), count)
    flat = out.reshape(-1)
    places, j = None, 0
    while len(row) and j < size:
        x = mix(h + U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = j + ((x & U64(0xFFFFFFFF)) % U64(size - j)).astype(np.int64)
        if places is None:
            cell, first = pick, pick
        else:
            at = np.arange(len(row))
            cell = places[at, pick].astype(np.int64)
            places[at, pick] = places[at, j]
            places[at, j] = cell
        np.minimum.at(flat, row * size + cell, U64(j) << U64(32) | x >> U64(32))
        j += 1
        left = (out.max(1) >= U64(j) << U64(32))[row]
        row, h = row[left], h[left]
        if places is None:
            places = np.repeat(np.arange(size, dtype=np.uint16)[None], len(row), 0)
            at, first = np.arange(len(row)), first[left]
            places[at, first] = 0
            places[at, 0] = first
        else:
            places = places[left]
    return out


def parity_sketch(h: np.ndarray, borders: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """Packed parities of the elements that fall in each of `bits` buckets; differing bits <= differing elements."""
    count = np.diff(borders)
    row = np.repeat(np.arange(len(count)), count)
    odd = np.bincount(row * bits + (h >> U64(40)).astype(np.int64) % bits, minlength=len(count) * bits).reshape(len(count), bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def _describe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, identity (128 bits), bands and sketch of each document."""
    salt = mix(np.arange(BANDS, dtype=U64))
    for rb in rows:
        for a in range(0, len(rb), 250):
            part = rb.slice(a, 250)
            h, borders = shingle_sets(part.column("text"))
            n = np.diff(borders)
            total = lambda x: np.diff(np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])[borders])
            identity = np.stack([total(mix(h)), total(mix(h ^ U64(0xA5A5A5A5A5A5A5A5)))], 1)
            signature = super_minhash(h, borders).reshape(len(n), BANDS, ROWS)
            band = salt[None, :].repeat(len(n), 0)
            for k in range(ROWS):
                band = mix(band * U64(0x9E3779B97F4A7C15) + signature[:, :, k])
            sketch = parity_sketch(h, borders)
            columns = [part.column("doc_id"), part.column("_batch"), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in identity], pa.binary()), pa.array([x.tolist() if m else [] for x, m in zip(band.view(np.int64), n, strict=True)], pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketch], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "batch", "n", "identity", "bands", "sketch"])


def near_enough(na: np.ndarray, nb: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (na + nb - common)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b); component is the least node that is reachable.

    Alternating large and small stars: each node hands its larger neighbours, then its smaller ones, to the
    least; rounds grow with the logarithm of the longest path. Minima are aggregated and joined back, so a
    node with very many neighbours is split like any skewed join key; edges are rewritten after each round.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where("b > a" if large else "true").join(least, "a").select(F.col("b").alias("v"), "m")
        if not large:
            moved = moved.unionAll(least.select(F.col("a").alias("v"), "m"))
        return moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    edges, last, path = edges.where("a <> b").select("a", "b").distinct(), None, None
    while True:
        edges, path = restage(star(star(edges, True), False), "stars", path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            atexit.register(delete, edges.sparkSession, path)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select("b", "b").distinct())
        last = tuple(now)


def _emit_sets(root: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, None
        for batch, rb in by_batch(rows):
            if batch != now:
                answer, now = read_answer(root, batch), batch
                ids = pa.chunked_array(answer.column("doc_id")).combine_chunks() if answer else pa.array([], pa.int64())
            part = rb.filter(pa.compute.is_in(rb.column("doc_id"), ids))
            if len(part):
                h, borders = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([h[a:b].tobytes() for a, b in zip(borders, borders[1:], strict=False)], pa.binary())], ["doc_id", "shingles"])

    return run


def _confirm(root: str, percent: int):
    """Pairs (a, b) of this batch's documents b whose sets, compared in full, are near enough."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hubs, pairs = None, {}, {}
        for batch, rb in by_batch(rows):
            if batch != now:
                answer, now, hubs, pairs = read_answer(root, batch), batch, {}, {}
                if answer:
                    for a, b, s in zip(*(answer.column(c).to_pylist() for c in ("a", "b", "shingles")), strict=True):
                        if s is None:
                            pairs.setdefault(b, []).append(a)
                        else:
                            hubs.setdefault(a, []).append(np.frombuffer(s, U64))
            part = rb.filter(pa.compute.is_in(rb.column("doc_id"), pa.array(list(pairs), pa.int64())))
            if not len(part):
                continue
            h, borders = shingle_sets(part.column("text"))
            found = []
            for b, x, y in zip(part.column("doc_id").to_pylist(), borders, borders[1:], strict=False):
                own = h[x:y]
                for a in pairs[b]:
                    for other in hubs.get(a, ()):
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * common >= percent * (len(own) + len(other) - common):
                            found.append((a, b))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def confirm(staged: DataFrame, batches: int, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links. Sets of the a travel to the batches of their b; texts stay."""
    spark, where = staged.sparkSession, nodes.select(F.col("doc_id").alias("id"), "batch")
    wanted = write_answers(pairs.select(F.col("a").alias("id")).distinct().join(where, "id").select(F.col("id").alias("doc_id"), "batch"), batches, "wanted")
    sets, sets_path = restage(staged.mapInArrow(_emit_sets(wanted), "doc_id long, shingles binary"), "sets", wanted)
    placed, placed_path = restage(pairs.join(where, pairs.b == where.id).select("a", "b", "batch"), "placed", None)
    hubs = placed.select("batch", "a").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a")
    sent = write_answers(placed.withColumn("shingles", F.lit(None).cast("binary")).unionByName(hubs.withColumn("b", F.lit(None).cast("long"))), batches, "pairs")
    links = stage(staged.mapInArrow(_confirm(sent, percent), "a long, b long"), "links")
    for path in (sets_path, placed_path, sent):
        delete(spark, path)
    return links


def _across(percent: int):
    """Pairs of different components that meet in a task of _blocked and that the sketch doesn't rule out; rows come sorted by task."""

    def found(t: pa.Table) -> pa.RecordBatch:
        task = np.stack([t.column(c).to_numpy() for c in ("band", "z", "x", "y")])
        first = np.flatnonzero(np.append(True, (task[:, 1:] != task[:, :-1]).any(0))[: len(t)])
        end = np.repeat(np.append(first[1:], len(t)), np.diff(np.append(first, len(t))))
        ids, n, own, low, side, inner = (t.column(c).to_numpy() for c in ("doc_id", "n", "component", "low", "side", "inner"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(t), -1)
        i, d, out = np.arange(len(t)), 0, []
        while len(i := i[i + d + 1 < end[i]]):  # each row with the one d places on
            d += 1
            j = i + d
            meet = (own[i] != own[j]) & (inner[i] | (side[i] != side[j])) & ~(low[i] & low[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            x, y = i[meet], j[meet]
            apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)
            # apart <= |A| + |B| - 2 * common, so common is at most:
            near = near_enough(n[x], n[y], (n[x] + n[y] - apart) // 2, percent)
            out.append(np.stack([ids[x[near]], ids[y[near]]]))
        pairs = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(0)), pa.array(pairs.max(0))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rb in batches:
            held.append(rb)
            n += len(rb)
            if n >= TOGETHER:
                t = pa.Table.from_batches(held)
                task = np.stack([t.column(c).to_numpy() for c in ("band", "z", "x", "y")])
                last = int(np.flatnonzero((task != task[:, -1:]).any(0)).max(initial=-1)) + 1  # the last task may go on
                if last:
                    yield found(t.slice(0, last))
                held, n = t.slice(last).combine_chunks().to_batches(), len(t) - last
        if n:
            yield found(pa.Table.from_batches(held))

    return run


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (band, doc_id, n) of bands with several components, with their component and `own`, the band's component of the most members."""
    joined = components(links)
    placed = stage(members.join(joined, members.doc_id == joined.node, "left").select("band", "doc_id", "n", F.coalesce("component", "doc_id").alias("component")), "labelled")
    shares = placed.groupBy("band", "component").agg(F.count("*").alias("many"))
    bands = shares.groupBy("band").agg(F.count("*").alias("kinds"), F.max(F.struct("many", "component")).alias("most")).where("kinds > 1")
    return stage(placed.join(bands.select("band", F.col("most.component").alias("own")), "band"), "open")


def _to_hubs(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member outside its band's largest component with a few members of it, drawn by a hash."""
    draw = F.xxhash64("doc_id", "band")
    inner = rest.where("component = own").groupBy("band", F.pmod(draw, F.lit(HUBS)).alias("slot")).agg(F.min(F.struct(draw.alias("h"), "doc_id", "n")).alias("hub"))
    pairs = rest.where("component <> own").join(inner.select("band", F.col("hub.doc_id").alias("a"), F.col("hub.n").alias("na")), "band")
    return pairs.where(f"100 * least(n, na) >= {percent} * greatest(n, na)").select("a", F.col("doc_id").alias("b")).distinct()


def _blocked(rest: DataFrame, percent: int) -> DataFrame:
    """Members dealt to tasks so that each pair of different components of a band that sizes allow meets in one of them.

    band, z, x, y name a task, side is a member's side in it. A member is in its class of sizes and, as `low`, in the
    next one (two members that sizes allow are in one class or in neighbouring ones; two that are low don't meet). Those outside the largest component, the
    few, are cut into blocks and meet each block of the few and of the others; so the others' copies grow with the
    few alone. A band without the few has none.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * (1 + 1e-9))).cast("int")
    t = rest.withColumn("class", size).withColumn("z", F.explode(F.array("class", F.col("class") + 1))).withColumn("few", (F.col("component") != F.col("own")).cast("int"))
    counts = t.groupBy("band", "z").agg(F.sum("few").alias("n_few"), F.sum(1 - F.col("few")).alias("n_other"), F.max(F.col("class") == F.col("z")).alias("of_class")).where("n_few > 0 and of_class")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    t = t.join(counts.select("band", "z", blocks("n_few").alias("xs"), blocks("n_other").alias("ys")), ["band", "z"])
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("few") == 1, F.col("xs")).otherwise(F.col("ys"))).cast("int")
    # few are blocks 0 to xs - 1, others xs to xs + ys - 1; a task is (x, y) with x < xs and x <= y
    t = t.withColumn("own_block", F.when(F.col("few") == 1, own).otherwise(own + F.col("xs")))
    other = F.when(F.col("few") == 1, F.sequence(F.lit(0), F.col("xs") + F.col("ys") - 1)).otherwise(F.sequence(F.lit(0), F.col("xs") - 1))
    t = t.withColumn("other", F.explode(other))
    return t.select("band", "z", F.least("own_block", "other").alias("x"), F.greatest("own_block", "other").alias("y"), (F.col("own_block") > F.col("other")).cast("int").alias("side"), (F.col("own_block") == F.col("other")).alias("inner"), (F.col("class") != F.col("z")).alias("low"), "doc_id", "component")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, int]:
    """(groups, staged documents with the column _batch, number of batches).

    groups, a row per row of docs: doc_id, batch, n_shingles, component_id (least doc_id that links reach),
    kept. Words are cut at ASCII white space, A-Z lower-cased; a text of 1 to 4 words is one shingle. A
    null or blank text has an empty set, is linked with nothing and kept. A null doc_id is linked with
    nothing, has a null component and is kept. Rows of equal doc_id count as one document: they are linked
    through their id. Equal sets are linked without a comparison, others from percent of Jaccard similarity on. An empty table gives no rows.
    """
    staged, batches, _ = stage_batches(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "near")
    slim = staged.select("doc_id", "_batch", "text")
    described = stage(slim.mapInArrow(_describe, "doc_id long, batch int, n long, identity binary, bands array<long>, sketch binary"), "described")
    usable = described.where("doc_id is not null and n > 0")
    heads = usable.groupBy("identity").agg(F.min("doc_id").alias("head"))
    nodes = stage(usable.join(heads.select("identity", F.col("head").alias("doc_id")), ["identity", "doc_id"]).dropDuplicates(["doc_id", "identity"]).drop("identity"), "nodes")
    members = nodes.select("doc_id", "n", F.explode("bands").alias("band"))
    full = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(members.join(full, "band"), "members")
    degree = members.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    ranked = members.join(degree, "doc_id")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("minus"), "n")).alias("hub"))
    stars = members.join(hubs, "band").select((-F.col("hub.minus")).alias("a"), F.col("hub.n").alias("na"), F.col("doc_id").alias("b"), "n").where("a <> b")
    stars = stars.where(f"100 * least(n, na) >= {percent} * greatest(n, na)").select("a", "b").distinct()
    look = nodes.select(F.col("doc_id").alias("id"), "n", "sketch")
    stars = _sketched(stars, look, percent)
    links = confirm(slim, batches, nodes, stage(stars, "starpairs"), percent)
    near = _sketched(_to_hubs(_open(members, links), percent), look, percent)
    links = links.unionAll(confirm(slim, batches, nodes, stage(near, "hubpairs"), percent))
    rest = _blocked(_open(members, links), percent)
    rest = rest.join(look, rest.doc_id == look.id).drop("id")
    task, parts = ["band", "z", "x", "y"], int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rest.repartition(parts, *task).sortWithinPartitions(*task).mapInArrow(_across(percent), "a long, b long").distinct()
    more = confirm(slim, batches, nodes, stage(pairs, "crosspairs"), percent)
    repeated = usable.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    same = usable.join(repeated, "doc_id").join(heads, "identity").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    final = components(links.unionAll(more).unionAll(same))
    heads_of = heads.join(final, heads["head"] == final.node, "left").select("identity", "head", F.coalesce("component", "head").alias("component"))
    groups = described.join(heads_of, "identity", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    groups = groups.select("doc_id", "batch", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return groups.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), staged, batches


def first_of_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that aren't kept: one document stays of each group. Other columns may have any name."""
    own = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"carry {i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")))
    groups, staged, batches = near_duplicates(own, percent)
    rest = without(staged, batches, groups.where("not kept"), own.columns)
    return rest.select(*(F.col(c if c in ("doc_id", "text") else f"`carry {i}`").alias(c) for i, c in enumerate(docs.columns)))


def _sketched(pairs: DataFrame, look: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the sketches don't rule out."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            one = lambda c: np.frombuffer(b"".join(rb.column(c).to_pylist()), np.uint64).reshape(len(rb), -1)
            na, nb = rb.column("na").to_numpy(), rb.column("nb").to_numpy()
            apart = np.bitwise_count(one("sa") ^ one("sb")).sum(1, dtype=np.int64)
            yield pa.RecordBatch.from_struct_array(rb.select(["a", "b"]).to_struct_array().filter(pa.array(near_enough(na, nb, (na + nb - apart) // 2, percent))))

    of = lambda side: look.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")
