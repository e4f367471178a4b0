"""Every query over folders of small tables: odd rows with clashing extra columns, empty tables, and the pipeline against plain versions."""

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from rasterloom.llm import bpe, bwt, minhash, queries

EXTRA = "_batch string, _ord int, learn string, batch int, hash string, bucket int, host string, rule int, score string, held_out string, component_id string, `carry 0` int, n int"
LONG = "lorem ipsum dolor sit amet consectetur " * 5200  # 200,000 characters


def odd_documents():
    r = random.Random(3)
    prose = lambda k: " ".join(r.choice(["the", "cat", "sat", "on", "a", "mat", "with", "every", "dog", "idiot"]) + r.choice("aeiou") for _ in range(k))
    texts = [None, "", "  \n\t ", "123 !? 456", LONG, LONG + "x", "A b", "a  B", "İstanbul été กข", "see <|endoftext|> here", *(prose(60) for _ in range(12))]
    texts += texts[10:13] + [texts[10] + " end"]
    return [(k, t, [None, "en", "fr"][k % 3]) for k, t in enumerate(texts)] + [(3, "123 !? 456", "en"), (None, "no id at all", "en"), (None, None, None)]


def write(spark, folder, documents, pages, labels, benchmark):
    extra = ", ".join(f"cast({k} as {t.rsplit(' ', 1)[1]}) as {t.rsplit(' ', 1)[0]}" for k, t in enumerate(EXTRA.split(", ")))
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(3).selectExpr("*", *extra.split(", ")).write.parquet(f"{folder}/{name}.parquet")
    docs = spark.createDataFrame(documents, "doc_id long, text string, lang string").selectExpr("*", "'s' source", "cast(length(text) as long) n_chars", *[e for e in extra.split(", ")])
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    save(pages, "page_id long, url string, html string", "pages")
    save(labels, "doc_id long, quality int, toxic int", "labels")
    save(benchmark, "item_id long, text string", "benchmark")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    pages = [(1, None, ""), (2, "", None), (3, "http://a.com/en/", "x"), (3, "http://a.com/en/", "x"), (None, "http://É.net/de/8?q#f", None), (4, "x" * 100_000, "")]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(20)] + [(None, 1, 1), (5, None, None), (6, 1, 1)]
    return write(spark, tmp_path_factory.mktemp("odd"), odd_documents(), pages, labels, [(1, "every dog"), (1, "every dog"), (2, None), (3, ""), (None, "lorem ipsum dolor sit amet consectetur lorem")])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_empty(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def rows(spark, folder, name):
    """doc_id or page_id -> rows of a query."""
    out = {}
    for r in queries.QUERIES[name](spark, folder).collect():
        out.setdefault(r[0], []).append(r)
    return out


def crc(d, m):
    return zlib.crc32(str(d).encode()) % m if d is not None else 0


def test_op1(spark, odd):
    docs = [(d, t) for d, t, _ in odd_documents()]
    small = brute.repeats([(d, t) for d, t in docs if t is None or len(t) < 10_000])
    got = rows(spark, odd, "op1_suffix_dedup")
    assert sum(map(len, got.values())) == len(docs)
    for d, want in small.items():
        assert all(tuple(x)[1:] in {(*want[:3], brute.sha(want[3])), (0, 0, 0, brute.sha(b"")), (12, 0, 0, brute.sha(b"no id at all"))} for x in got[d])
    # the second of the two long texts keeps the end that the first lacks: strings of 50 bytes that end in x
    assert (got[4][0].n_removed, got[5][0].n_removed) == (0, len(LONG)) and got[5][0].kept_sha256 == brute.sha(b"x")


def test_op1_carries_any_column(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    names = ["_batch", "_ord", "carry 0", "hash"]
    got = bwt.remove_repeats(docs, names)
    assert got.columns[-4:] == names and {tuple(x) for x in got.select(*(f"`{n}`" for n in names)).collect()} == {tuple(x) for x in docs.select(*(f"`{n}`" for n in names)).collect()}
    assert minhash.first_of_groups(docs).columns == docs.columns


def test_op2(spark, odd):
    got = rows(spark, odd, "op2_url_filter")
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 1, 3: 2, None: 1, 4: 1}
    assert [tuple(got[k][0])[1:5] for k in (1, 2, 3, None)] == [("", "", None, "allow"), ("", "", None, "allow"), ("a.com", "/en/", "com/en/", "block"), ("É.net", "/de/8", "net/de/", "allow")]


def test_op3(spark, odd):
    docs, got = odd_documents(), rows(spark, odd, "op3_language_id")
    known = brute.profiles([(t, lang) for d, t, lang in docs if crc(d, 5)])
    for d, t, _ in docs:
        if d is not None and d != 3:
            lang, score = brute.language(t, known)
            assert (got[d][0].held_out, got[d][0].lang_pred) == (crc(d, 5) == 0, lang) and abs(got[d][0].score - score) < 1e-9
    assert got[0][0].lang_pred == got[1][0].lang_pred == got[3][0].lang_pred == "und" and len(got[3]) == len(got[None]) == 2


def test_op4(spark, odd):
    got = rows(spark, odd, "op4_toxic_spans")
    assert sum(map(len, got.values())) == len(odd_documents()) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for own in got.values() for x in own)
    assert all(got[d][0].held_out == (crc(d, 3) == 1) for d in range(20)) and got[0][0].score == pytest.approx(got[1][0].score)


def test_op5(spark, odd):
    got = sorted((x.doc_id, x.item_id) for x in queries.op5_string_tiling(spark, odd).collect() if x.doc_id is not None and x.item_id is not None)
    want = sorted((d, k) for d, t, _ in odd_documents() if d is not None and t and len(t) < 10_000 for k in brute.leaks(t, [(1, "every dog"), (1, "every dog")]))
    assert got == want and {x.doc_id for x in queries.op5_string_tiling(spark, odd).collect() if x.item_id is None} == {4, 5}


def test_op6(spark, odd):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, odd, "op6_byte_bpe")
    for d, t, _ in odd_documents():
        ids = theirs.encode_ordinary(t or "")
        want = (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((t or "").encode()))
        assert want in [tuple(x)[1:4] for x in got[d]]


def test_op7(spark, odd):
    docs = [(d, t) for d, t, _ in odd_documents()]
    got = {d: own[0] for d, own in rows(spark, odd, "op7_super_minhash").items()}
    for d, (n, component) in brute.groups(docs, 85).items():
        if d != 3:
            assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (n, component, d == component)
    assert got[5].component_id == 4 and got[None].component_id is None and got[None].kept


def test_op8(spark, odd):
    got = rows(spark, odd, "op8_tiff_media")
    for d, t, _ in odd_documents():
        data = (t or "").encode()
        whole = data.ljust(max(192, -(-len(data) // 192) * 192))
        assert (len(data), len(whole), brute.sha(whole), zlib.crc32(whole[-16:])) in [tuple(x)[1:5] for x in got[d]]
    assert len({tuple(x)[1:] for x in got[0] + got[1]}) == 1


def test_op9(spark, odd):
    got = rows(spark, odd, "op9_suffix_tree")
    assert sum(map(len, got.values())) == len(odd_documents()) and all(x.score < 0 and x.base_score < 0 for own in got.values() for x in own)
    assert got[0][0].score == got[1][0].score == got[2][0].score and got[0][0].n_tokens == 1 and got[4][0].n_tokens == 6 * 5200 + 1
    assert all(got[d][0].held_out == (crc(d, 5) == 1) for d in range(20))


def test_op10(spark, odd):
    tok, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = sorted(queries.op10_token_shards(spark, odd).collect(), key=lambda x: x.start)
    texts = {}
    for d, t, _ in odd_documents():
        texts.setdefault(d, []).append(t or "")
    assert [x.doc_id for x in got] == sorted((d for d, _, _ in odd_documents()), key=lambda d: (d is not None, d or 0))
    for x in got:
        want = [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts[x.doc_id]]
        assert x.start == at and (x.n_tokens, x.ids_crc32) in [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in want]
        at += x.n_tokens


def test_pipeline_equals_plain_versions(spark, tmp_path):
    r = random.Random(11)
    words = {lang: ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(80)] for lang, letters in (("en", "abcdefgh"), ("fr", "mnopqrst"))}
    prose = lambda lang, k: " ".join(r.choice(words[lang]) for _ in range(k))
    docs, passage = [], prose("en", 20)
    for k in range(40):
        lang = ["en", "fr"][k % 2]
        t = prose(lang, 45)
        if k % 5 == 0:
            t = f"{prose(lang, 10)} {passage} {prose(lang, 20)}"
        docs.append((k, t, lang))
    items = [(1, docs[12][1]), (2, prose("fr", 12)), (3, None)]
    docs += [(40 + k, docs[k][1], docs[k][2]) for k in (1, 2)] + [(50, docs[3][1] + " x", "fr"), (51, None, "en"), (52, "123 !?", None), (53, "zz " * 40, None)]
    docs += [(60, f"{prose('fr', 20)} {items[1][1]} {prose('fr', 9)}", "fr"), (None, prose("en", 30), "en")]
    folder = write(spark, tmp_path, docs, [], [], items)
    known = brute.profiles([(t, lang) for _, t, lang in docs])
    left = [(d, t) for d, t, _ in docs if brute.language(t, known)[1] >= corpus_pipeline.LEAST_SCORE]
    assert {53, 52, 51} == {d for d, _, _ in docs} - {d for d, _ in left}
    own = brute.groups(left, 80)
    left = [(d, t) for d, t in left if d is None or own[d][1] == d]
    assert not {41, 42, 50} & {d for d, _ in left}
    cut = brute.repeats(left)
    left = [(d, cut[d][3].decode()) for d, _ in left]
    assert any(cut[d][1] for d, _ in left)
    left = [(d, t) for d, t in left if not brute.leaks(t, items)]
    assert not {12, 60} & {d for d, _ in left} and len(left) > 30
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for d, t in left:
        ids = theirs.encode_ordinary(t)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t.encode()))
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, folder).collect()}
    assert got == want
