"""Hand-computed fixtures, round trips and the SQL twins of a few queries on the smallest tables."""

import random
import struct
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import scalar
from rasterloom.operators import entropy, gradients, quantize, resample, stencil
from rasterloom.plans import catalogue
from rasterloom.sources import container, formats, older
from rasterloom.streaming import images

DATA = "/root/testdata/sf0.001"
INDEX = [[2, 2, 3], [2, 4, 3], [1, 4, 4]]


def matrix(spark, rows):
    return spark.createDataFrame([(1, y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id long, y int, x int, idx int")


def test_prediction_runs_and_keys(spark):
    res = entropy.med_encode(matrix(spark, INDEX), spark.createDataFrame([(1, 5)], "image_id long, size int"))
    assert [r.e for r in res.orderBy("y", "x").collect()] == [7, 5, 6, 5, 7, 4, 4, 6, 6]
    runs = entropy.runs(res, "e")
    assert [(r.value, r.len) for r in runs.orderBy("run_no").collect()] == [(7, 1), (5, 1), (6, 1), (5, 1), (7, 1), (4, 2), (6, 2)]
    assert {r.key: r.freq for r in entropy.run_keys(runs).collect()} == {13: 1, 15: 2, 18: 1, 19: 1, 21: 2}
    assert entropy.code_bits(entropy.codes(entropy.run_keys(runs))).first()["bits"] == 16


def test_codes_are_prefix_free():
    table = entropy.code_table({k: k * k + 1 for k in range(20)})
    assert sum(2.0**-n for _, n in table.values()) == 1
    assert entropy.code_table({7: 3}) == {7: (0, 1)}


def test_long_codes_are_limited():
    """Frequencies that grow like Fibonacci numbers make the longest codes; they stay within 32 bits and prefix free."""
    freq = {0: 1, 1: 1}
    for k in range(2, 60):
        freq[k] = freq[k - 1] + freq[k - 2]
    table = entropy.code_table(freq)
    assert max(n for _, n in table.values()) <= 32 and sum(2.0**-n for _, n in table.values()) == 1
    texts = sorted(f"{code:0{n}b}" for code, n in table.values())
    assert not any(b.startswith(a) for a, b in zip(texts, texts[1:], strict=False))


def test_bits_and_runs():
    """Packed bits against text, and a stream whose codes are longer than what is looked up at once."""
    r = random.Random(5)
    pairs = [(r.randrange(1 << n), n) for n in [r.randint(1, 32) for _ in range(300)]]
    text = "".join(f"{v:0{n}b}" for v, n in pairs)
    assert container.pack_bits(*zip(*pairs, strict=True)) == int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    assert container.unpack_bits(container.pack_bits([5, 0, 7], [3, 3, 3]), 3, 3) == [5, 0, 7] and container.pack_bits([], []) == b""
    flat = np.array([k for k in range(20) for _ in range(1 << max(0, 17 - k))])
    flat = np.array(r.sample(flat.tolist(), len(flat)))
    longest, entries, table, count, body = container.coded_runs(flat)
    codes = {}
    for k in range(entries):
        key, n, code = struct.unpack_from("<iBI", table, 9 * k)
        codes[code, n] = key
    assert max(n for _, n in codes) > container.PEEK
    assert np.array_equal(container.read_runs(body, count, longest, codes)[0], flat)
    with pytest.raises(ValueError):
        container.read_runs(body[:50], count, longest, codes)


def test_file_size_is_the_report(spark):
    """The report's total of each image is its file's size."""
    base, rest = catalogue._two_layers(spark, DATA)
    parts = [container.layer_rows(flat, palette, tag, queue) for (flat, palette, queue, _), tag in ((base, container.BASE), (rest, container.RESIDUAL))]
    sizes = {x.image_id: x.n for x in container.assembled(parts[0].unionByName(parts[1])).selectExpr("image_id", "octet_length(file) n").collect()}
    report = {x.image_id: x.bytes for x in catalogue.size_report(spark, DATA).where("section_group = 'TOTAL'").collect()}
    assert report == sizes


def test_shapes_must_agree(spark):
    planes = matrix(spark, INDEX).selectExpr("image_id", "y", "x", "cast(idx as double) v")
    assert stencil.aligned(planes, planes).count() == 9
    with pytest.raises(Exception, match="shapes differ"):
        stencil.aligned(planes, planes.where("x < 2")).collect()


def test_a_short_queue(spark):
    """Pairs beyond the queue's end take the first descriptor, but one seen on the second edge of the pixel that took the last has none."""
    ix = matrix(spark, [[0, 1], [2, 3]]).withColumn("recon", F.col("idx") * 10.0).withColumn("v", F.col("recon"))
    queue = spark.createDataFrame([(1, 0, 0, 1, 0, 0, 1, 0, 0, False)], "image_id long, queue_idx long, lo int, hi int, first_x int, first_y int, shape int, direction int, width int, change boolean")
    sides = gradients._described(gradients._sides(ix), gradients.edges(ix, 2), queue)
    # numbers: 0-1 is 0, 0-2 (second edge of the same pixel) would be 1 and is lost, 1-3 and 2-3 take 0
    assert sorted({(x.lo, x.hi) for x in sides.collect()}) == [(0, 1), (1, 3), (2, 3)]


def test_bounded_runs(spark):
    planes = spark.createDataFrame([(1, 0, i, float(k) + 0.5) for i, k in enumerate([0, 1, 2, 3, 4, 7, 8, 10])], "image_id long, y int, x int, v double")
    clusters, _ = quantize.bounded_runs(planes, 1.0, 2)
    assert [r.idx for r in clusters.orderBy("k").collect()] == [0, 0, 0, 1, 1, 2, 2, 3]
    with pytest.raises(ValueError):
        quantize.bounded_runs(planes, 0.0, 2)


def test_colours(spark):
    t = spark.createDataFrame([(255, 0, 0), (10, 200, 37), (0, 0, 0)], "r int, g int, b int").select(*(F.expr(e).alias(n) for e, n in zip(scalar.lab(), "lab", strict=True)))
    got = np.array(t.collect())
    assert np.allclose(got, [[53.2329, 80.1093, 67.2201], [70.5294, -70.1574, 63.2149], [0, 0, 0]], atol=1e-3)
    for variant in ("current", "legacy"):
        assert [tuple(r) for r in t.select(*(F.expr(e) for e in scalar.rgb(variant))).collect()] == [(255, 0, 0), (10, 200, 37), (0, 0, 0)]


def test_pixels_that_arrive(spark, tmp_path):
    """A stream of pixel files, read in two goes from its checkpoint, gives what the batch plan gives."""
    rows = [(1, 0, 0, 255, 0, 0), (1, 0, 1, 10, 200, 37), (2, 0, 0, 0, 0, 0)]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "image_id long, y int, x int, r int, g int, b int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = images.lab_stream(spark, f"{tmp_path}/in").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 2 + k
    want = scalar.with_lab(spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")).collect()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, want))


def test_formats_by_hand():
    """Files that the module's encoders don't write."""
    grey = formats.decode_pnm(b"P5 # grey\n2 1\n#more\n65535\n" + bytes([1, 2, 200, 9]))
    assert grey.tolist() == [[[1] * 3, [200] * 3]]
    head = lambda kind, w, h, bits, flags, mapped=0, entries=0: struct.pack("<BBBHHBHHHHBB", 2, mapped, kind, 0, entries, 24 if mapped else 0, 0, 0, w, h, bits, flags) + b"id"
    assert formats.decode_tga(head(2, 1, 2, 24, 0) + bytes([1, 2, 3, 4, 5, 6])).tolist() == [[[6, 5, 4]], [[3, 2, 1]]]  # from the bottom
    assert formats.decode_tga(head(1, 2, 1, 8, 32, 1, 2) + bytes([1, 2, 3, 7, 8, 9, 1, 0])).tolist() == [[[9, 8, 7], [3, 2, 1]]]
    assert formats.decode_tga(head(10, 4, 1, 24, 32) + bytes([1, 1, 2, 3, 4, 5, 6, 129, 7, 8, 9])).tolist() == [[[3, 2, 1], [6, 5, 4], [9, 8, 7], [9, 8, 7]]]
    assert formats.decode_tga(head(2, 1, 1, 16, 32) + struct.pack("<H", 31 << 10 | 5)).tolist() == [[[255, 0, 41]]]
    psd = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 1, 4, 8, 3) + struct.pack(">I", 2) + b"ab" + bytes(8) + struct.pack(">HHHH", 1, 2, 5, 2) + bytes([253, 9, 3, 1, 2, 3, 4, 253, 7])
    assert formats.decode_psd(psd).tolist() == [[[9, 1, 7], [9, 2, 7], [9, 3, 7], [9, 4, 7]]]
    rle = b"#?RADIANCE\n\n-Y 1 +X 8\n" + bytes([2, 2, 0, 8]) + bytes([136, 64]) + bytes([8, *range(8)]) + bytes([132, 0, 4, 1, 2, 3, 4]) + bytes([136, 128])
    light = (np.array([[64, g, b] for g, b in zip(range(8), [0] * 4 + [1, 2, 3, 4], strict=True)]) / 256) ** (1 / 2.2) * 255
    assert np.abs(formats.decode_hdr(rle)[0] - light).max() <= 0.5
    assert [formats.sniff(b) for b in (b"P6\n", psd, rle, head(2, 1, 1, 24, 0) + b"x", b"GIF89a", b"")] == ["pnm", "psd", "hdr", "tga", None, None]


def test_half_floats(spark):
    values = [1.0009, -3.7, 0.25, 1e-6, 70000.0]
    t = spark.createDataFrame([(v,) for v in values], "v double").select(F.expr(scalar.half("v")).alias("h"))
    assert np.allclose([r.h for r in t.collect()][:3], container.half_bits(np.array(values[:3])).view("<f2").astype(float))
    assert [r.h for r in t.collect()][3:] == [0.0, float("inf")]


def test_zigzag_and_dct(spark):
    assert stencil.zigzag(3) == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (1, 2), (2, 1), (2, 2)]
    planes = spark.createDataFrame([(1, i // 4, i % 4, float(i)) for i in range(16)], "image_id long, y int, x int, v double")
    c = {r.p: r.c for r in stencil.dct(planes, 4).collect()}
    assert np.allclose([c[0], c[1], c[3], c[4], c[12], c[5]], [30, -4.4609, -0.3170, -17.8435, -1.2681, 0], atol=1e-3)
    back = {(r.y, r.x): r.v for r in stencil.idct(stencil.dct(planes, 4), 4).collect()}
    assert all(abs(back[i // 4, i % 4] - i) < 1e-9 for i in range(16))


def test_container_round_trip(spark):
    ix = matrix(spark, INDEX)
    palette = spark.createDataFrame([(1, k, k / 4) for k in range(1, 5)] + [(1, 0, 9.0)], "image_id long, idx int, value double")
    rows = ix.unionByName(spark.createDataFrame([(1, 3, x, 0) for x in range(3)], ix.schema))
    back = container.read_container(container.write_container(rows, palette))
    assert {(r.y, r.x, r.idx) for r in back.collect()} == {(r.y, r.x, r.idx) for r in rows.collect()}
    with pytest.raises(ValueError):
        container.parse(b"\1\0\0\0\1\0\0\0\x99\0\0")


TWINS = """quantised_run_statistics med_decode pair_first_seen segment_shapes change_points_strict apply_gradients apply_gradients_along reconstruct_channels pyramid nearest_palette
similar_colours near_boundary ssim upsample_index_odd upsample_index_older upsample_index_box resize_error noise_border noise_normal similar_border_blur lab_mse palette_errors layer_sum
size_report container_layers container_queue container_reduced container_second container_dct container_older_queue descriptor_fields change_points_first format_scan image_scan bfs3d huffman_codes""".split()


@pytest.mark.parametrize("name", TWINS)
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    own = catalogue.QUERIES[name](spark, DATA).toPandas()
    theirs = con.sql(catalogue.ORACLE[name]).df()
    columns = sorted(own)
    assert columns == sorted(theirs)
    order = lambda t: t[columns].sort_values(columns).reset_index(drop=True)
    own, theirs = order(own), order(theirs)
    for c in columns:
        if own[c].dtype == object:
            assert own[c].tolist() == theirs[c].tolist()
        else:
            assert np.allclose(own[c].to_numpy(float), theirs[c].to_numpy(float), atol=2e-5)


@pytest.mark.parametrize("odd", [True, False])
@pytest.mark.parametrize("shape", [(5, 6), (6, 7), (2, 3)])
def test_upsampled_indexes(spark, odd, shape):
    """Against a loop over pixels, both nearest rules; the odd matrix of an even side has a last sample that is missing."""
    r, (h, w), first = random.Random(3), shape, int(odd)
    lab = [[r.uniform(0, 20) for _ in range(3)] for _ in range(9)]
    small = {(y, x): r.randrange(9) for y in range((h - first) // 2) for x in range((w - first) // 2)} or {(0, 0): 4}

    def middle(a, b):
        return a if a == b else min(range(9), key=lambda k: (round(abs(lab[k][0] - (lab[a][0] + lab[b][0]) / 2), 9), k))

    def boxed(a, b):
        inside = [k for k in range(9) if all(min(lab[a][c], lab[b][c]) - 5 <= lab[k][c] <= max(lab[a][c], lab[b][c]) + 5 for c in range(3))]
        return a if a == b else min(inside, key=lambda k: (round(sum((lab[k][c] - (lab[a][c] + lab[b][c]) / 2) ** 2 for c in range(3)), 6), [a, b, *range(9)].index(k)))

    ix = spark.createDataFrame([(1, y, x, k) for (y, x), k in small.items()], "image_id long, y int, x int, idx int")
    palette = spark.createDataFrame([(1, k, v[0], *v) for k, v in enumerate(lab)], "image_id long, idx int, value double, l double, a double, b double")
    for rule, nearest in ((middle, stencil.nearest_to_midpoint), (boxed, resample.nearest_in_box)):
        full = {(y, x): small.get((y // 2, x // 2), 0) for y in range(first, h, 2) for x in range(first, w, 2)}
        for axis, size in ((1, w), (0, h)):
            move = lambda p, d, axis=axis: (p[0] + d * (1 - axis), p[1] + d * axis)
            lines = {p[1 - axis] for p in full}
            for p in [(q, k) if axis else (k, q) for q in lines for k in range(1 - first, size, 2)]:
                a, b = full.get(move(p, -1)), full.get(move(p, 1))
                full[p] = rule(a, b) if a is not None and b is not None else b if a is None else a
        got = {(x.y, x.x): x.idx for x in resample.upsample_index(ix, palette, w, h, odd, nearest).collect()}
        assert got == full


def test_descriptor_thresholds(spark):
    """Lag and fold against a loop that keeps the last emitted descriptor."""
    r = random.Random(4)
    rows = [(1, lo, 9, seg, 2, r.randrange(99), r.randrange(99), r.randrange(3), r.randrange(2), r.randrange(3), (0, lo * 20 + seg, lo, 9)) for lo in range(6) for seg in range(20)]
    schema = "image_id long, lo int, hi int, seg int, n int, first_x int, first_y int, shape int, direction int, width int, flush struct<late:int,seq:int,lo:int,hi:int>"
    for threshold in (0.25, 0.5, 1.0, 1.2, 1.3, 1.5):
        last, expected = {}, []
        for row in rows:
            lo, seg, now = row[1], row[3], row[7:10]
            old = last.get(lo)
            if old is None or (old[0] != now[0]) * 1.0 + (old[1] != now[1]) * 0.5 + (old[2] != now[2]) * 0.3 >= threshold or old[1] != now[1]:
                last[lo] = now
                expected.append((len(expected), lo, *now, seg > 0))
        got = gradients.descriptors(spark.createDataFrame(rows, schema), threshold)
        assert sorted(map(tuple, got.select("queue_idx", "lo", "shape", "direction", "width", "change").collect())) == expected


def test_older_containers(spark):
    r = np.random.default_rng(6)
    idx, palette = np.sort(r.integers(0, 7, (5, 9)), axis=1), np.column_stack([r.uniform(0, 100, 7), r.uniform(-128, 127, (7, 2)), r.uniform(0, 9, 7)])
    queue, points = [3, 15, 0, 9, 4], [(1, 2, 3), (65535, 0, 4)]
    residual = {"block": 16, "keep": 2, "step": 8.0, "coefficients": r.integers(-127, 128, 12)}
    for full in (None, (18, 10)):
        got = older.parse_first(older.first_version(palette, idx, queue, points, 4, full, residual), full is not None)
        assert np.array_equal(got["idx"], idx) and got["full"] == (full or (9, 5))
        assert np.abs(got["palette"][:, :3] - palette[:, :3]).max() <= 0.5 and np.array_equal(got["palette"][:, 3], np.floor(palette[:, 3]))
        assert got["gradients"] == {"bits": 4, "queue": queue, "points": points}
        assert got["residual"]["coefficients"].tolist() == residual["coefficients"].tolist() and got["residual"]["step"] == 8.0
    layers = [{"palette": palette[: k + 3], "idx": idx % (k + 3), "queue": queue[:k], "points": points[:k], "bits": 6} for k in range(4)]
    data = older.second_version(layers)
    got = older.parse_second(data)["layers"]
    assert len(got) == 4
    for own, back in zip(layers, got, strict=True):
        assert np.array_equal(own["idx"], back["idx"]) and own["queue"] == back["queue"] and own["points"] == back["points"]
        assert np.allclose(own["palette"][:, :3], back["palette"], rtol=1e-3, atol=1e-3)
    assert len(older.parse_second(older.second_version(layers[:2]))["layers"]) == 2
    with pytest.raises(ValueError):
        older.parse_second(data[:40])
    ix = matrix(spark, INDEX)
    colours = spark.createDataFrame([(1, k, float(k), 0.5 * k, -1.0 * k, 0.0) for k in range(5)], "image_id long, idx int, l double, a double, b double, error double")
    for version in (1, 2):
        back = older.read_older(older.write_older(ix, colours, version), version).collect()
        assert {(x.y, x.x, x.idx, x.l, x.b) for x in back} == {(y, x, v, float(v), -float(v)) for y, row in enumerate(INDEX) for x, v in enumerate(row)}


def test_tiles_see_what_the_image_holds(spark, monkeypatch):
    """Neighbourhoods, edges and blurs are the same when an image is cut into tiles of three by three."""
    r = np.random.default_rng(9)
    cells = [(1, y, x, int(r.integers(0, 3)), float(r.integers(0, 200))) for y in range(11) for x in range(8)]
    planes = spark.createDataFrame(cells, "image_id long, y int, x int, idx int, v double").withColumn("recon", F.col("idx") * 5.0)
    found = []
    for tile in (256, 3):
        monkeypatch.setattr(stencil, "TILE", tile)
        made = [stencil.gauss3(planes), stencil.bilateral(planes), stencil.near_boundary(planes, 2), stencil.region_blur(planes), stencil.similar_border_blur(planes, ("recon",), 2, 6.0), stencil.soft_lowpass(planes), gradients.edges(planes, 8).drop("samples"), gradients._sides(planes)]
        found.append([sorted(map(tuple, t.collect())) for t in made])
    assert found[0] == found[1]


def test_region_blur_and_deblocking(spark):
    r = np.random.default_rng(7)
    v, idx = r.integers(0, 200, (8, 8)).astype(float), r.integers(0, 2, (8, 8))
    cells = [(1, y, x, int(idx[y, x]), float(v[y, x])) for y in range(8) for x in range(8)]
    planes = spark.createDataFrame(cells, "image_id long, y int, x int, idx int, v double")
    blurred = v.copy()
    for _ in range(2):
        for dy, dx in ((0, 1), (1, 0)):
            new = blurred.copy()
            for y in range(8):
                for x in range(8):
                    near = [(y + k * dy, x + k * dx) for k in (-1, 0, 1)]
                    near = [blurred[q] for q in near if min(q) >= 0 and max(q) < 8 and idx[q] == idx[y, x]]
                    new[y, x] = np.floor(sum(near) / len(near))
            blurred = new
    got = {(x.y, x.x): x.v for x in stencil.region_blur(planes, passes=2).collect()}
    assert all(got[p] == blurred[p] for p in np.ndindex(8, 8))
    expected = {}
    for y, x in np.ndindex(8, 8):
        top, weight = v[y, x], 1.0
        for by, bx, d in ((y // 4, x // 4 - 1, x % 4), (y // 4, x // 4 + 1, 3 - x % 4), (y // 4 - 1, x // 4, y % 4), (y // 4 + 1, x // 4, 3 - y % 4)):
            if d < 2 and 0 <= by < 2 and 0 <= bx < 2 and abs(jump := v[by * 4 + 2, bx * 4 + 2] - v[y, x]) < 60:
                u = (2 - d) / 2
                w = u * u * (3 - 2 * u) * (1 - abs(jump) / 60)
                top, weight = top + w * v[by * 4 + 2, bx * 4 + 2], weight + w
        expected[y, x] = top / weight
    got = {(x.y, x.x): x.v for x in stencil.deblocked(planes, 4, 2, 60.0).collect()}
    assert all(abs(got[p] - e) < 1e-9 for p, e in expected.items())


def test_kept_coefficients_restored(spark):
    v = np.random.default_rng(8).normal(0, 9, (8, 8))
    planes = spark.createDataFrame([(1, y, x, float(v[y, x])) for y, x in np.ndindex(8, 8)], "image_id long, y int, x int, v double")
    basis, cells = np.array(stencil.dct_basis(8)), stencil.zigzag(8)[:6]
    c, kept = basis @ v @ basis.T, np.zeros((8, 8))
    for p in cells:
        kept[p] = np.clip(np.round(c[p] / 0.5), -127, 127) * 0.5
    back = basis.T @ kept @ basis
    back *= 2.5 * min(np.abs(back).max() / 10, 1)
    got = {(x.y, x.x): x.v for x in stencil.restored_residual(stencil.keep_coefficients(stencil.dct(planes, 8), 8, 6, 0.5), 8, 0.5, 2.5).collect()}
    assert all(abs(got[p] - back[p]) < 1e-9 for p in np.ndindex(8, 8))
