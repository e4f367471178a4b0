"""The training-data operators against brute force, libraries and exact round trips, with nulls, empties and repeats."""

import collections
import hashlib
import itertools
import random
import struct
import zlib
from pathlib import Path

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from rasterloom.llm import bitpack, bpe, bwt, crf, langid, minhash, queries, suffixtree, tiff, tiling, urls

DATA = "/root/testdata/sf0.001"
TRICKY = ["a", "aa", "th", "İ", " ", "  ", "\n", "é", "ñ", "日本", "'s", "1", "22", "!", "?!", "\x1c", "\xa0", "\t", "x" * 30]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, batch int").repartition(parts)


def mixed(n=120):
    r = random.Random(5)
    base = ["ab" * 150, "x" * 200, "".join(r.choice("abc") for _ in range(400)), "the quick brown fox " * 10]
    rows = [(i, None if i % 17 == 0 else "" if i % 19 == 0 else "".join((b := r.choice(base))[(s := r.randrange(len(b))) : s + r.randrange(150)] for _ in range(3)) + "é" * r.randrange(60)) for i in range(n)]
    return rows + [(n, rows[3][1]), (None, rows[4][1])]


@pytest.mark.parametrize("hot", [bwt.HOT, 3])
def test_repeats_equal_brute_force(spark, hot):
    """With 3, most shared anchors are divided into windows."""
    rows = mixed()
    got = {r[0]: tuple(r)[1:] for r in bwt.remove_repeats(frame(spark, rows), hot=hot).collect()}
    assert got == {d: (*own[:3], brute.sha(own[3])) for d, own in brute.repeats(rows).items()}


def test_merged_order_is_sorted():
    r = np.random.default_rng(0)
    strings = [r.integers(97, 99, n).astype(np.uint8) for n in (60, 70, 81)]
    lengths = np.array([len(s) for s in strings])
    got = bwt.repeat_minimum(np.concatenate(strings), lengths, np.array([5, 3, 9]))
    want = {}
    for s, w in zip(strings, (5, 3, 9), strict=True):
        for i in range(len(s) - 49):
            want[s[i : i + 50].tobytes()] = min(want.get(s[i : i + 50].tobytes(), w), w)
    assert got.tolist() == [want[s[i : i + 50].tobytes()] for s in strings for i in range(len(s) - 49)]


def test_merged_common_prefixes():
    """Interleave and common prefixes of two shards of circles against sorting all of them."""
    r = np.random.default_rng(1)
    circles = [bytes(r.integers(97, 99, n).astype(np.uint8)) + b"\0" for n in (9, 12, 7, 11)]
    shards, turns = (circles[:2], circles[2:]), 8
    turned = [sorted(((c * 9)[k:][: len(c) * 8], c, k) for c in shard for k in range(len(c))) for shard in shards]
    bwts = [np.array([c[k - 1] for _, c, k in t], np.uint16) for t in turned]
    shard, common = bwt.merge_bwts(bwts, turns)
    prefixes = [[t[0][:turns] for t in own] for own in turned]
    own = [iter(p) for p in prefixes]
    merged = [next(own[s]) for s in shard]
    assert merged == sorted(prefixes[0] + prefixes[1])
    same = lambda a, b: next((k for k in range(turns) if a[k] != b[k]), turns)
    assert common[1:].tolist() == [same(a, b) for a, b in itertools.pairwise(merged)]


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    base = [r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(90)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
            w[r.randrange(len(w))] = str(r.random())
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "A b"), (103, "a  B"), (None, "a b"), (104, "x")]
    groups, _, _ = minhash.near_duplicates(frame(spark, rows).select("doc_id", "text"))
    got = {g.doc_id: (g.n_shingles, g.component_id, g.kept) for g in groups.collect()}
    assert got.pop(None) == (1, None, True)
    assert got == {d: (n, c, c == d) for d, (n, c) in brute.groups(rows, 85).items()}


def test_open_bands_lose_no_pair(spark, monkeypatch):
    """Blocks, size classes and the largest component together let each pair that sizes allow meet exactly once."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    r = random.Random(2)
    rows = [(b, d, r.choice([1, 2, 17, 85, 99, 100, 101, 118, 850, 1000]), r.choice([0, 0, 0, d])) for b in range(3) for d in range(1, 60)]
    rest = spark.createDataFrame([(*x, 0) for x in rows], "band long, doc_id long, n long, component long, own long")
    groups = collections.defaultdict(list)
    size = {(b, d): (n, c) for b, d, n, c in rows}
    for t in minhash._blocked(rest, 85).collect():
        groups[t.band, t.z, t.x, t.y].append(t)
    met = collections.Counter()
    for (band, *_), own in groups.items():
        assert len(own) < 40
        for a, b in itertools.combinations(own, 2):
            if (a.inner or a.side != b.side) and a.component != b.component and not (a.low and b.low):
                met[band, min(a.doc_id, b.doc_id), max(a.doc_id, b.doc_id)] += 1
    allowed = {(b, x, y) for b, x, y in itertools.product(range(3), range(1, 60), range(1, 60)) if x < y and size[b, x][1] != size[b, y][1] and 100 * min(size[b, x][0], size[b, y][0]) >= 85 * max(size[b, x][0], size[b, y][0])}
    assert allowed <= set(met) and max(met.values()) == 1
    # the workers' side, batches of 7 rows, with sketches that rule nothing out
    monkeypatch.setattr(minhash, "TOGETHER", 20)
    dealt = [(*k, t.side, t.inner, t.low, t.doc_id, t.component, size[t.band, t.doc_id][0], b"\0" * 256) for k in sorted(groups) for t in groups[k]]
    names = ["band", "z", "x", "y", "side", "inner", "low", "doc_id", "component", "n", "sketch"]
    whole = pa.table({c: [r[k] for r in dealt] for k, c in enumerate(names)})
    found = [p for b in minhash._across(85)(iter(whole.to_batches(max_chunksize=7))) for p in zip(*(b.column(c).to_pylist() for c in "ab"), strict=True)]
    assert sorted(found) == sorted((x, y) for _, x, y in allowed)


def test_pipeline_near_copies_from_80_percent(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(w)) for i, w in enumerate([base, base[:-10] + [f"z{i}" for i in range(10)], base[:-30] + [f"y{i}" for i in range(30)]])]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]
    assert minhash.near_duplicates(docs.select("doc_id", "text"))[0].where("kept").count() == 3


def test_bpe_equals_library(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, r = bpe.TextEncoder(bpe.MonoidBPE(ranks), public_tokenizers.PATTERN), random.Random(1)
    for text in ["", "a" * 3000, *("".join(r.choices(TRICKY, k=r.randrange(30))) for _ in range(400))]:
        ids = np.frombuffer(own(text), "<u4").tolist()
        assert ids == theirs.encode_ordinary(text)
        assert own.bpe.decode(ids) == text.encode()


def test_token_shards(spark):
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    tok = Tokenizer.from_file(path)
    rows = [(i, None if i == 4 else "".join(r.choices(TRICKY, k=r.randrange(30)))) for i in range(40)]
    at = 0
    got = {x.doc_id: tuple(x)[1:] for x in bitpack.tokenise_to_shards(frame(spark, rows), path, 2).collect()}
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for bits in (1, 3, 11, 16, 17):
        v = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
        assert np.array_equal(bitpack.unpack(bitpack.pack(v, bits), bits, len(v)), v)


def test_word_encoder():
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    tok, own = Tokenizer.from_file(path), bitpack.WordEncoder(path)
    texts = ["".join(r.choices("aAbZé\u0130'st dl.,;%%$<>=~\u0338\u093c\u0915\u0958\n\t\xa012\u0663\ud55c\u1112 \u1161-_|\ufb01\U0001f600 ", k=r.randrange(60))) for _ in range(2000)]
    texts += ["I\u1039\u0307 x", "I\u0331\u0307", "see <|endoftext|> here", "<|EndOfText|>", *("".join(r.choices(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "I", "\u0307", "S\u0323", " ", "<|"], k=r.randrange(9))) for _ in range(500))]
    texts += [None, "", "don't", "it's!", "<|endoftext|>", " word" * 1000]
    for _ in range(2):
        ids, counts = own(pa.array(texts))
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        own.known, own.old = {}, own.known
    assert not sum(map(len, own(pa.array([], pa.string()))))


def test_added_tokens_as_the_library(spark):
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(9)
    tok = Tokenizer.from_file(path)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "one", " two ", "don't", "\u00e9", "\n", "!?", "<|", "|>"]
    rows = [(0, "one <|endoftext|> two"), (1, None), *((i, "".join(r.choices(parts, k=r.randrange(9)))) for i in range(2, 200))]
    at = 0
    got = {x.doc_id: tuple(x)[1:] for x in bitpack.tokenise_to_shards(frame(spark, rows), path, 2).collect()}
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, tile):
    r = np.random.default_rng(0)
    for predictor in (1, 2):
        pages = [r.integers(0, 5, (37, 50, 3)).astype(np.uint8), r.integers(0, 65535, (20, 21)).astype(np.uint16), np.zeros((100, 60), np.uint8)]
        data = tiff.encode_tiff(pages, compression, predictor, rows=16, tile=tile)
        back = [tiff.page_pixels(data, o, t) for o, t in tiff.directories(data)]
        assert all(np.array_equal(b.squeeze(), p) for b, p in zip(back, pages, strict=True))


def golden(order, tags, body):
    """A file made by hand: header, body at 8, one directory; tags are (tag, field, values) with values of at most four bytes or an offset."""
    width = {3: "H", 4: "I"}
    entries = b"".join(struct.pack(f"{order}HHI", t, f, n) + struct.pack(f"{order}{len(v)}{width[f]}", *v).ljust(4, b"\0") for t, f, n, v in tags)
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8 + len(body)) + body + struct.pack(f"{order}H", len(tags)) + entries + b"\0\0\0\0"


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_golden(order):
    """Files and streams that the module didn't write."""
    read = lambda data: [tiff.page_pixels(data, o, t) for o, t in tiff.directories(data)]
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    assert tiff.lzw_decode(int("".join(f"{c:09b}" for c in codes).ljust(88, "0"), 2).to_bytes(11, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    # 2 x 3 pixels of two 16-bit planes, a strip each, offsets and counts written behind the pixels
    planes = (np.arange(12) * 1000).astype(f"{order}u2").reshape(3, 2, 2)
    body = planes[:, :, 0].tobytes() + planes[:, :, 1].tobytes() + struct.pack(f"{order}4I2H", 8, 20, 12, 12, 16, 16)
    file = golden(order, [(256, 3, 1, [2]), (257, 3, 1, [3]), (258, 3, 2, [16, 16]), (259, 3, 1, [1]), (273, 4, 2, [32]), (277, 3, 1, [2]), (278, 3, 1, [3]), (279, 4, 2, [40]), (284, 3, 1, [2])], body)
    assert read(file)[0].tolist() == planes.tolist()
    # 10 x 2 pixels of 1 bit, PackBits, bits by default
    file = golden(order, [(256, 3, 1, [10]), (257, 3, 1, [2]), (259, 3, 1, [32773]), (273, 4, 1, [8]), (278, 3, 1, [2]), (279, 4, 1, [6])], bytes([3, 0b10110000, 0b01000000, 0xFF, 0x80, 0]))
    assert read(file)[0][..., 0].tolist() == [[1, 0, 1, 1, 0, 0, 0, 0, 0, 1], [1] * 9 + [0]]
    # 3 x 1 pixels of 4 bits with differences
    file = golden(order, [(256, 3, 1, [3]), (257, 3, 1, [1]), (258, 3, 1, [4]), (259, 3, 1, [1]), (273, 4, 1, [8]), (278, 3, 1, [1]), (279, 4, 1, [2]), (317, 3, 1, [2])], bytes([0x9A, 0x10]))
    assert read(file)[0].ravel().tolist() == [9, 3, 4]
    # floats as differences of byte planes
    values = np.array([1.5, -2.25, 1e6, 0.125], ">f4")
    flat = values.view(np.uint8).reshape(4, 4).T.ravel()
    file = golden(order, [(256, 3, 1, [4]), (257, 3, 1, [1]), (258, 3, 1, [32]), (259, 3, 1, [1]), (273, 4, 1, [8]), (278, 3, 1, [1]), (279, 4, 1, [16]), (317, 3, 1, [3])], np.diff(flat, prepend=np.uint8(0)).tobytes())
    assert read(file)[0].ravel().view(np.float32).tolist() == values.tolist()


def test_tiff_limit(spark):
    """A page above the limit is an error row for files of others; texts have no limit."""
    file = bytearray(tiff.encode_tiff([np.zeros((40, 50), np.uint8), np.zeros((4, 5), np.uint8)]))
    media = spark.createDataFrame([(1, file)], "id long, media binary")
    assert [(r.page, r.error is None) for r in tiff.read_pages(media, "media", ["id"], 100).collect()] == [(0, False)]
    assert tiff.page_pixels(bytes(file), *next(tiff.directories(bytes(file))), most=2000).shape == (40, 50, 1)
    assert tiff.lzw_decode(tiff.lzw_encode(b"a" * 900), 100)[:100] == b"a" * 100 and len(tiff.packbits_decode(tiff.packbits_encode(b"a" * 9000), 100)) < 300


def test_tiff_rows(spark):
    file = bytearray(tiff.encode_tiff([np.zeros((4, 5), np.uint8), np.ones((4, 5), np.uint8)]))
    media = spark.createDataFrame([(1, file), (2, None), (3, bytearray(b"junk")), (4, file[:-9])], "id long, media binary")
    rows = [(r.id, r.page, r.error is None) for r in tiff.read_pages(media, "media", ["id"]).collect()]
    assert rows[:2] == [(1, 0, True), (1, 1, True)] and (3, 0, False) in rows and not any(r[0] == 2 for r in rows)
    got = {r.doc_id: r for r in tiff.text_digests(frame(spark, [(1, None), (2, "é" * 200)])).collect()}
    assert (got[1].n_bytes, got[1].payload_bytes, got[2].n_bytes, got[2].payload_bytes) == (0, 192, 400, 576)
    assert got[1].payload_sha256 == hashlib.sha256(b" " * 192).hexdigest()


def test_tiles_equal_brute_force(spark):
    r = random.Random(4)
    for _ in range(60):
        item = np.array([r.randint(1, 4) for _ in range(r.randint(5, 30))])
        doc = np.concatenate([[r.randint(0, 4) for _ in range(r.randrange(15))], item[r.randrange(len(item)) :], item[: r.randrange(len(item))]]).astype(int)
        assert sorted(tiling.tiles(doc, item)) == brute.tiles(doc, item)
    item = " ".join(f"w{i}" for i in range(20))
    halves = item.split()
    docs = frame(spark, [(1, "start " + item + " end"), (2, " ".join(halves[10:] + ["and"] + halves[:10])), (3, " ".join(halves[:8])), (4, None), (5, "")])
    bench = spark.createDataFrame([(9, item), (10, None), (11, "too short")], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in tiling.contaminated(docs, bench).collect()} == {(1, 9), (2, 9)}
    assert {x.doc_id for x in tiling.decontaminated(docs, bench).collect()} == {3, 4, 5}
    docs = frame(spark, [(1, "it is Too, short here"), (2, "too long, short"), (3, "\u6771\u4eac\u90fd\u306b\u4f4f\u3093\u3067\u3044\u308b\u3002"), (4, "\u6771\u4eac\u5927\u962a"), (5, "!?")])
    bench = spark.createDataFrame([(11, "too short"), (12, "\u79c1\u306f\u6771\u4eac\u90fd\u306b\u4f4f\u3093\u3067"), (13, "?!"), (14, "short")], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in tiling.contaminated(docs, bench).collect()} == {(1, 11), (1, 14), (2, 14), (3, 12)}


def test_repeated_seeds_take_linear_memory():
    """A word repeated 60,000 times against an item of 2,000: pairs of places would be 120 million."""
    known = tiling.Benchmark([(1, "so " * 2000), (2, "so " * 30 + "a b c d e f")])
    assert tiling.leaks(known, ["so " * 60_000, "x"], 0.6, {}) == [(0, 1, 2000, 2000, 1.0, 1), (0, 2, 30, 36, 30 / 36, 1)]
    assert len(tiling.tiles(np.ones(50_000, np.int64), np.ones(3000, np.int64))) == 1


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 60)
    items = [(k, " ".join(f"t{k}x{j}" for j in range(8))) for k in range(12)]
    docs = frame(spark, [(k, "start " + t + " end") for k, t in items] + [(99, "none of it")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in tiling.contaminated(docs, bench).collect()) == [(k, k) for k in range(12)]
    assert [x.doc_id for x in tiling.decontaminated(docs, bench).collect()] == [99]


def test_url_rules(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7")]
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/7?x"), (2, "https://b.com/en/1#y"), (3, None), (4, "no scheme"), (5, "http://casino-win.example.org/bets")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block")
    assert got[3][:3] == got[4][:3] == ("", "", None) and got[5][3] == "block"


def test_url_model():
    """Weights are where the penalised likelihood's gradient vanishes; held-out URLs of the labelled table are told apart; no evidence is no reason to block."""
    rows = [("http://aaa.com/x", 1), ("http://aab.com/y", 1), ("http://bbb.com/x", 0), ("http://bbc.com/y", 0), ("", 0)]
    model = urls.UrlModel(rows, rounds=4000, rate=2.0, shrink=1e-2)
    x = np.zeros((len(rows), urls.BUCKETS))
    for i, (u, _) in enumerate(rows):
        grams = {f"{m}{t[k : k + n]}" for m, t in (("h", "^" + urls.parts(u)[0] + "$"), ("p", urls.parts(u)[1] + "$")) for n in (3, 4, 5) for k in range(len(t) - n + 1)}
        x[i, list({int(hashlib.md5(g.encode()).hexdigest()[:4], 16) for g in grams})] = 1
    x /= np.sqrt(np.maximum(1, x.sum(1)))[:, None]
    p = 1 / (1 + np.exp(-x @ model.weight - model.bias))
    y = np.array([r[1] for r in rows])
    assert np.allclose([model.score(*urls.parts(u)) for u, _ in rows], p)
    assert np.abs(x.T @ (p - y) / len(y) + 1e-2 * model.weight).max() < 1e-6 and abs((p - y).mean()) < 1e-6
    model, kept = urls.UrlModel(urls.LABELLED), [r for r in urls.labelled_table() if urls.held_out(r[0])]
    found = [(label, model.score(*urls.parts(u)) >= 0.5) for u, label in kept]
    assert len(kept) > 100 and sum(a == b for a, b in found) > 0.9 * len(found) and not any(b and not a for a, b in found)
    assert max(model.score(*urls.parts(u)) for u in (None, "", "HTTP://A.COM?x", "no scheme")) < 0.5
    assert 0 < urls.UrlModel([]).score("a", "/") < 1


def test_url_parts_as_expressions(spark):
    odd = [None, "", "x", "://", "a://B.C", "http://H\u00c9.Com/P?q#f", "http://h#a/b?c", "http://h?x/y", "u://a://b/c", "http://h/\n/x", "http://\n/x", "\n://h/p", "http:///p", "http://h//"]
    pages = spark.createDataFrame([(i, u, 5) for i, u in enumerate(odd)], "page_id long, url string, host int")
    got = {r.page_id: (r.host, r.path) for r in urls.judge(pages, []).collect()}
    assert got == {i: urls.parts(u) for i, u in enumerate(odd)}


OPS = ["op1_suffix_dedup", "op2_url_filter", "op3_language_id", "op7_super_minhash", "media_payloads", "word_base_scores"]


@pytest.mark.parametrize("name", OPS)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    own, theirs = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE[name])
    columns = sorted(own.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda t: sorted(map(tuple, t[columns].astype(object).where(t[columns].notna(), "").astype(str).to_numpy().tolist()))
    assert rows(own.toPandas()) == rows(theirs.df())


def test_languages(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog of the house " * 3, "en"), ("der hund und die katze in dem haus " * 3, "de")] * 5)]
    profiles = langid.learn(spark.createDataFrame(rows + [(99, "x", None), (98, None, "en")], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "the house of the dog"), (2, "die katze und der hund"), (3, None), (4, "123 !?"), (5, "")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, profiles, ["doc_id"]).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}


def test_toxic_field(spark):
    r = random.Random(6)
    plain = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join([*r.choices(plain, k=30), *(["vilename" + r.choice("abc")] if i % 4 == 0 else []), *r.choices(plain, k=9)])) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs] + [(None, 1), (3, None)], "doc_id long, toxic int")
    field = crf.learn(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    test = spark.createDataFrame([(1, "w1 w2 Vilenamec w3"), (2, "w1 w2 w3"), (3, None), (4, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in crf.score(test, field, ["doc_id"]).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4)] == [1, 0, 0, 0] and [tuple(s) for s in got[1].spans] == [(6, 15)]
    p, q, u, v = (np.random.default_rng(k).random(50) for k in range(4))
    x, want = 1.0, []
    for a, b, c, d in zip(p, q, u, v, strict=True):
        x = (a * x + b) / (c * x + d)
        want.append(x)
    assert np.allclose(crf.moebius_scan(p, q, u, v), want)


def test_field_messages_equal_all_paths():
    """Marginals, pairs of states and the clean path's probability against the sum over all paths of each chain."""
    r = np.random.default_rng(3)
    emission, moves, starts = r.normal(0, 2, 12), r.normal(0, 1, (2, 2)), np.array([0, 5, 5, 6, 12])
    chain = crf.Messages(emission, crf.begins(starts), moves)
    p, pairs, clean = chain.marginals(), chain.moves(), chain.clean()
    for lo, hi in zip(starts, starts[1:], strict=False):
        weight = {path: np.exp(sum(emission[lo + k] for k, y in enumerate(path) if y) + sum(moves[a, b] for a, b in itertools.pairwise(path))) for path in itertools.product((0, 1), repeat=hi - lo)}
        z = sum(weight.values())
        for k in range(hi - lo):
            assert np.isclose(p[lo + k], sum(w for path, w in weight.items() if path[k]) / z)
            for i, j in itertools.product((0, 1), repeat=2):
                assert np.isclose(pairs[lo + k, 2 * i + j], sum(w for path, w in weight.items() if k and path[k - 1 : k + 1] == (i, j)) / z)
        assert np.isclose(np.exp(clean[lo:hi].sum()), weight[(0,) * (hi - lo)] / z)


def test_field_knows_contexts():
    """Insults that training has never seen score by the words around them; without labels of both classes nothing does."""
    r = random.Random(6)
    plain, docs = [f"w{i}" for i in range(200)], []
    for i in range(300):
        words = r.choices(plain, k=30)
        insult = r.choice("bcdfg") * 2 + str(r.randrange(9)) + "x"
        words[10:10] = (f"you are such a {insult} today" if i % 3 == 0 else "you have a nice idea he is today such are what" if i % 3 == 1 else "").split()
        docs.append((" ".join(words), int(i % 3 == 0)))
    field = crf.ToxicField(docs)
    chain, starts = field.tag(["w1 you are such a qwzop today w4", "w3 you have a nice qwzop he is", "", " \u0130 "])
    assert chain.marginals()[:8].argmax() in range(1, 7) and chain.marginals()[1:7].max() > 0.5
    scores = field.scores(chain, starts)
    assert scores[0] > 0.9 and max(scores[1:]) < 0.1 and scores[2] == field.scores(None, np.array([0, 0]))[0]
    for one_class in ([], [("a b", 0)], [("a b", 1)]):
        field = crf.ToxicField(one_class)
        assert 0 <= field.scores(*field.tag(["a b"]))[0] <= 1


def test_suffix_tree_scores(spark):
    rows = [(i, None if i == 3 else "" if i == 4 else f"The cat {'sat ' * (i % 3)}on mat{i % 5}.") for i in range(40)]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "doc_id % 5 = 1 as held_out")
    got = {r.doc_id: r for r in suffixtree.score(docs).collect()}
    count = collections.Counter(w for d, t in rows if d % 5 != 1 for w in [*brute.lowered(t), None])
    n, v = sum(count.values()), len(count)
    for d, t in rows:
        own = [*brute.lowered(t), None]
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert abs(got[d].base_score - sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-9
        assert got[d].score < 0


def brute_tree_score(corpus, text):
    """log10 of text by dictionaries: contexts of up to DEPTH bytes that are seen twice and diverge."""
    symbols = lambda t: b"\n" * suffixtree.DEPTH + " ".join(brute.lowered(t)).encode() + b"\n"
    count = collections.defaultdict(collections.Counter)
    for b in map(symbols, corpus):
        for i in range(suffixtree.DEPTH, len(b)):
            for d in range(suffixtree.DEPTH + 1):
                count[b[i - d : i]][b[i]] += 1
    kept, total = {b""}, sum(count[b""].values())

    def p(history, x):
        out = (count[b""][x] + 0.5) / (total + 128)
        for d in range(1, len(history) + 1):
            c = history[len(history) - d :]
            if c not in kept:
                return out
            out = (count[c][x] + 12 * out) / (sum(count[c].values()) + 12)
        return out

    for c in sorted(filter(None, count), key=len):
        n = sum(count[c].values())
        k = len(count[c])
        limit = k * (1 - 2 / (9 * k) + 3.0902 * (2 / (9 * k)) ** 0.5) ** 3
        if n >= 2 and c[1:] in kept and 2 * sum(m * np.log(m / n / p(c[1:], x)) for x, m in count[c].items()) > limit:
            kept.add(c)
    b = symbols(text)
    return sum(np.log10(p(b[i - suffixtree.DEPTH : i], b[i])) for i in range(suffixtree.DEPTH, len(b)))


def test_suffix_tree_is_a_distribution():
    """The next symbol's probabilities sum to one after any history; contexts by chance are pruned, telling ones kept."""
    r = np.random.default_rng(5)
    data = r.choice(np.frombuffer(b"abcd", np.uint8), 40_000)
    data[1::9], data[2::9] = 120, 121  # x is always followed by y
    grams = np.zeros(len(data) - suffixtree.DEPTH, np.uint64)
    for k in range(suffixtree.DEPTH + 1):
        grams = grams << np.uint64(8) | data[k : k + len(grams)]
    kinds, times = np.unique(grams, return_counts=True)
    tree = suffixtree.SuffixTree(*suffixtree.levels(kinds, times.astype(float), range(suffixtree.DEPTH + 1)))
    for history in (b"abcdab", b"aaaaax", b"zzzzzz", b"\n\n\n\nab"):
        own = np.array([int.from_bytes(history + bytes([x]), "big") for x in range(256)], np.uint64)
        assert abs(tree.probability(own, suffixtree.DEPTH).sum() - 1) < 1e-9
    assert ord("x") in tree.contexts[1] and np.allclose(suffixtree.likely(np.array([1, 10, 100])), [10.83, 29.59, 149.45], rtol=0.05)


def test_suffix_tree_equals_brute_force(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(2, 9))) for _ in range(30)]
    rows = [(i, None if i == 7 else " ".join(r.choices(vocabulary, k=r.randint(0, 30)))) for i in range(60)]
    got = {x.doc_id: x.score for x in suffixtree.score(frame(spark, rows).selectExpr("doc_id", "text", "doc_id % 5 = 1 as held_out")).collect()}
    corpus = [t for d, t in rows if d % 5 != 1]
    for d, t in rows[::4]:
        assert abs(got[d] - brute_tree_score(corpus, t)) < 1e-6


def test_suffix_tree_keeps_rare_contexts(spark):
    """What is seen twice counts as much in a corpus of five million symbols as in a small one."""
    rare = "qzjxv wkqpz vvkjq xzwqk jjqzp"
    got = []
    for filler in (10, 5000):
        rows = [(i, "the cat sat on the mat " * 50) for i in range(2, filler)] + [(0, rare), (1, rare), (-1, rare)]
        docs = frame(spark, rows).selectExpr("doc_id", "text", "doc_id = -1 as held_out")
        got.append({x.doc_id: x.score for x in suffixtree.score(docs).collect()}[-1])
    assert got[1] > got[0] - 12
