"""All queries over image relations, and DuckDB SQL that computes the same rows.

EPS, STEPS and the other constants are the parameters of the queries; results are rounded so that both
engines' floating-point sums compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import entropy, gradients, noise, quantize, resample, stencil
from ..sources import container, formats, older
from ..sources import relations as R
from ..sources.shared import settled, shared_folder
from . import layers, twins

EPS, STEPS, EDGE, SEGMENT = 0.05, 2, 8, 8

# SQL of the relations and of steps that several queries share.
PX = "px as (select vec_id as image_id, cast(i // 8 as int) as y, cast(i % 8 as int) as x, cast(embedding[i + 1] as double) as v from embeddings, range(64) t(i))"
RGB = "rgb as (select vec_id as image_id, cast(p // 8 as int) as y, cast(p % 8 as int) as x, " + ", ".join(f"cast(floor(least(1.0, greatest(0.0, cast(embedding[(p + {c}) % 64 + 1] as double) + 0.5)) * 255) as int) as {n}" for c, n in zip((0, 21, 42), "rgb", strict=True)) + " from embeddings, range(64) t(p))"
BIG = "big as (select cast(0 as bigint) as image_id, cast(n // 100 as int) as y, cast(n % 100 as int) as x, cast(l_quantity * 5 as int) as r, cast(round(l_discount * 100) * 25 as int) as g, cast(round(l_tax * 100) * 31 as int) as b from (select *, row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 as n from lineitem))"
SIG = "sig as (select user_id as image_id, 0 as y, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as x, cast(value as double) as v from events where user_id is not null)"
VOX = f"vox as (select image_id, cast(floor(v / {EPS}) as int) as k, count(*) as n, sum(v) as s from px group by all)"
CLUSTER = f"isl as (select *, k - row_number() over (partition by image_id order by k) as island from vox), blk as (select *, (row_number() over (partition by image_id, island order by k) - 1) // {STEPS + 1} as block from isl), vc as (select *, cast(dense_rank() over (partition by image_id order by island, block) - 1 as int) as idx from blk), pal as (select image_id, idx, sum(s) / sum(n) as value, cast(sum(n) as bigint) as n from vc group by all)"
IX = f"ix as (select p.image_id, p.y, p.x, p.v, c.idx from px p join vc c on p.image_id = c.image_id and cast(floor(p.v / {EPS}) as int) = c.k)"
BASE = f"with {PX}, {VOX}, {CLUSTER}, {IX}"
MED = """nb as (select image_id, y, x, idx, lag(idx) over (partition by image_id, y order by x) as w, lag(idx) over (partition by image_id, x order by y) as n from ix),
nc as (select *, lag(n) over (partition by image_id, y order by x) as nw from nb), sz as (select image_id, cast(count(*) as int) as size from pal group by all),
med as (select nc.image_id, y, x, cast(idx - case when y = 0 and x = 0 then 0 when y = 0 then w when x = 0 then n when nw >= greatest(w, n) then least(w, n) when nw <= least(w, n) then greatest(w, n) else w + n - nw end + size as int) as e from nc join sz using (image_id))"""
RUNS = """sq as (select image_id, y * 8 + x as seq, e from med), ch as (select *, case when e = lag(e) over (partition by image_id order by seq) then 0 else 1 end as c from sq),
rn as (select *, sum(c) over (partition by image_id order by seq) - 1 as run_no from ch), runs as (select image_id, cast(run_no as bigint) as run_no, any_value(e) as value, count(*) as len from rn group by image_id, run_no)"""
KEYS = "mx as (select image_id, max(len) as max_run from runs group by all), keys as (select image_id, max_run, cast(value * (max_run + 1) + len - 1 as bigint) as key, count(*) as freq from runs join mx using (image_id) group by all)"
EDGES = """ed as (select a.image_id, 2 * (a.y * 8 + a.x) + d.nth as edge_seq, a.x, a.y, a.idx as ca, b.idx as cb, least(a.idx, b.idx) as lo, greatest(a.idx, b.idx) as hi, a.v as va, b.v as vb, b.y as ny
from ix a, (values (0, 1, 0), (1, 0, 1)) d(nth, dx, dy), ix b where b.image_id = a.image_id and b.x = a.x + d.dx and b.y = a.y + d.dy and a.idx <> b.idx)"""


def _r(*columns: str, digits: int = 6):
    return [F.round(c, digits).alias(c) for c in columns]


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    px = R.planes_of_embeddings(spark, d)
    clusters, palette = quantize.bounded_runs(px, EPS, STEPS)
    return quantize.index_matrix(px, clusters, EPS), palette


def _sizes(palette: DataFrame) -> DataFrame:
    return palette.groupBy("image_id").agg(F.count("*").cast("int").alias("size"))


def _residuals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ix, palette = _indexed(spark, d)
    return entropy.med_encode(ix), palette


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    ix, palette = _indexed(spark, d)
    return quantize.decoded(ix, palette).select("image_id", "y", "x", F.col("v").alias("p"), F.col("recon").alias("q"))


def _lab(pixels: DataFrame) -> DataFrame:
    return scalar.with_lab(pixels.select("image_id", "y", "x", "r", "g", "b"))


def quantised_run_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: planes, buckets, clusters, index matrix, prediction and runs, summed up by image."""
    px = R.planes_of_embeddings(spark, d)
    clusters, _ = quantize.bounded_runs(px, EPS, STEPS)
    res = entropy.med_encode(quantize.index_matrix(px, clusters, EPS))
    runs = entropy.runs(res, "e").groupBy("image_id").agg(F.count("*").alias("n_runs"), F.max("len").alias("max_run"), F.sum("len").alias("pixels"))
    return runs.join(clusters.groupBy("image_id").agg(F.max("size").cast("long").alias("palette_size")), "image_id")


def lab_convert(spark, d):
    return _lab(R.rgb_of_embeddings(spark, d)).select("image_id", "y", "x", *_r("l", "a", "b", digits=5))


def lab_roundtrip(spark, d):
    t = _lab(R.rgb_of_embeddings(spark, d))
    return t.select("image_id", "y", "x", *(F.expr(e).alias(n) for e, n in zip(scalar.rgb(), "rgb", strict=True)))


def lab_roundtrip_legacy(spark, d):
    t = _lab(R.rgb_of_embeddings(spark, d))
    return t.select("image_id", "y", "x", *(F.expr(e).alias(n) for e, n in zip(scalar.rgb("legacy"), "rgb", strict=True)))


def voxel_agg(spark, d):
    return quantize.voxels(_lab(R.raster_of_lineitem(spark, d)), (5.0, 5.0, 5.0)).select("image_id", "kl", "ka", "kb", "n", *_r("sum_l", "sum_a", "sum_b", digits=4))


def quantize_bfs1d(spark, d):
    _, palette = _indexed(spark, d)
    return palette.select("image_id", "idx", *_r("value"), "n")


def quantize_direct(spark, d):
    return quantize.direct(R.planes_of_embeddings(spark, d), EPS).select("image_id", "k", "idx", *_r("value", "error"), "n")


def signal_palette(spark, d):
    return quantize.direct(R.planes_of_events(spark, d), 25.0).select("image_id", "k", "idx", *_r("value", "error"), "n")


def palette_decode(spark, d):
    return _pairs(spark, d).select("image_id", "y", "x", F.round("q", 6).alias("recon"))


def residual_plane(spark, d):
    return _pairs(spark, d).select("image_id", "y", "x", F.round(F.col("p") - F.col("q"), 6).alias("residual"))


def cluster_error(spark, d):
    ix, palette = _indexed(spark, d)
    return quantize.decoded(ix, palette).groupBy("image_id", "idx").agg(F.round(F.max(F.abs(F.col("v") - F.col("recon"))), 6).alias("error"))


def plane_ranges(spark, d):
    return R.planes_of_embeddings(spark, d).groupBy("image_id").agg(F.round(F.min("v"), 6).alias("lo"), F.round(F.max("v"), 6).alias("hi"), F.round(F.avg(F.abs("v")), 6).alias("mean_abs"))


def half_float(spark, d):
    return R.planes_of_embeddings(spark, d).select("image_id", "y", "x", F.round(F.expr(scalar.half("v")), 9).alias("h"))


def descriptor_codes(spark, d):
    t = R.rgb_of_embeddings(spark, d).select("image_id", "y", "x", (F.col("r") % 4).alias("shape"), (F.col("g") % 4).alias("direction"), (F.col("b") % 4).alias("width"))
    return t.select("image_id", "y", "x", *(F.expr(f"cast({scalar.pack_descriptor(n, old)} as int)").alias(f"{'old' if old else 'code'}{n}") for n in (2, 4, 6) for old in (False, True)))


def descriptor_fields(spark, d):
    """What unpacking gives back of packed descriptors, by bits and version."""
    codes = descriptor_codes(spark, d)
    read = lambda n, old: zip(("shape", "direction", "width"), scalar.unpack_descriptor(f"{'old' if old else 'code'}{n}", n, old), strict=True)
    return codes.select("image_id", "y", "x", *(F.expr(f"cast({e} as int)").alias(f"{'old' if old else 'new'}{n}_{f}") for n in (2, 4, 6) for old in (False, True) for f, e in read(n, old)))


def easing(spark, d):
    t = R.planes_of_embeddings(spark, d).withColumn("t", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") + 0.5)))
    return t.select("image_id", "y", "x", *(F.round(F.expr(scalar.eased("t", str(s))), 6).alias(f"s{s}") for s in range(4)))


def med_encode(spark, d):
    return _residuals(spark, d)[0]


def med_decode(spark, d):
    res, palette = _residuals(spark, d)
    return entropy.med_decode(res, _sizes(palette))


def rle(spark, d):
    return entropy.runs(_residuals(spark, d)[0], "e").select("image_id", F.col("run_no").cast("long").alias("run_no"), "value", "len")


def rle_roundtrip(spark, d):
    return entropy.unrolled(entropy.runs(_residuals(spark, d)[0], "e"), 8)


def run_key_freq(spark, d):
    return entropy.run_keys(entropy.runs(_residuals(spark, d)[0], "e")).select("image_id", "max_run", F.col("key").cast("long").alias("key"), "freq")


def huffman_codes(spark, d):
    return entropy.codes(run_key_freq(spark, d))


def huffman_bits(spark, d):
    return entropy.code_bits(huffman_codes(spark, d))


def _layer_parts(planes: DataFrame, eps: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(matrix with recon, palette, descriptors, blended pixels) of one layer over planes."""
    clusters, palette = quantize.bounded_runs(planes, eps, STEPS)
    flat = settled(quantize.decoded(quantize.index_matrix(planes, clusters, eps), palette))
    matrix = flat.select("image_id", "y", "x", "v", "idx")
    edge = gradients.edges(matrix, EDGE)
    queue = gradients.descriptors(gradients.segments(edge, matrix, 64), 1.0)
    return flat, palette, queue, gradients.blended(flat, edge, queue, EDGE, linear=True)


def _sections(flat: DataFrame, palette: DataFrame, queue: DataFrame, group: str) -> DataFrame:
    runs = entropy.runs(entropy.med_encode(flat), "e")
    return entropy.section_sizes(palette, entropy.codes(entropy.run_keys(runs)), queue, group)


def _two_layers(spark: SparkSession, d: str) -> tuple[tuple, tuple]:
    """The parts of a base layer over the embeddings' planes and of its residual layer."""
    base = _layer_parts(R.planes_of_embeddings(spark, d), EPS)
    rest = base[0].select("image_id", "y", "x", "v").join(base[3], ["image_id", "y", "x"]).select("image_id", "y", "x", (F.col("v") - F.col("recon")).alias("v"))
    return base, _layer_parts(rest, 0.02)


def size_report(spark, d):
    base, rest = _two_layers(spark, d)
    sections = _sections(*base[:3], "BASE").unionByName(_sections(*rest[:3], "RESIDUAL"))
    header = base[0].select("image_id").distinct().select("image_id", F.lit("HEADER").alias("section_group"), F.lit("sizes").alias("section"), F.lit(8).cast("long").alias("bytes"))
    report = entropy.size_report(sections.unionByName(header), base[0])
    return report.select("image_id", "section_group", "section", "bytes", *_r("bits_a_pixel", "percent", "ratio", digits=4))


def container_layers(spark, d):
    """Base and residual layers with their queues, written as files and read again."""
    base, rest = _two_layers(spark, d)
    parts = [container.layer_rows(flat, palette, tag, queue) for (flat, palette, queue, _), tag in ((base, container.BASE), (rest, container.RESIDUAL))]
    return container.read_container(container.assembled(parts[0].unionByName(parts[1]))).select("image_id", "layer", "y", "x", "idx", *_r("value", digits=9))


def container_queue(spark, d):
    """Descriptors and, where one is a change, its point (else -1), as container files give them back."""
    flat, palette = _flat(spark, d)
    queue = gradients.descriptors(gradients.segments(gradients.edges(flat, EDGE), flat, SEGMENT), 0.25)
    files = settled(container.assembled(container.layer_rows(flat, palette, container.BASE, queue, 6)))
    fields = zip(("shape", "direction", "width"), scalar.unpack_descriptor("code", 6), strict=True)
    codes = container.read_queue(files).select("image_id", "queue_idx", *(F.expr(f"cast({e} as int)").alias(f) for f, e in fields))
    points = container.read_points(files).select("image_id", "queue_idx", "x", "y")
    return codes.join(points, ["image_id", "queue_idx"], "left").fillna(-1, ["x", "y"])


def container_reduced(spark, d):
    """Three channels of one plane, the first at odd and the others at even places, as reduced files."""
    flat, palette = _flat(spark, d)
    parts = [container.layer_rows(stencil.subsample(flat, "idx", odd=k == 0, size=(8, 8) if k == 0 else None), palette, container.BASE + k) for k in range(3)]
    rest = container.layer_rows(flat, palette, container.RESIDUAL, gradients=False)
    for own in parts:
        rest = rest.unionByName(own)
    return container.read_container(container.assembled(rest, (8, 8)), True).select("image_id", "layer", "y", "x", "idx", *_r("value", digits=9))


def edges(spark, d):
    t = gradients.edges(_indexed(spark, d)[0], EDGE)
    return t.select("image_id", "edge_seq", "x", "y", "ca", "cb", "lo", "hi", F.size("samples").cast("long").alias("n_samples"))


def pair_first_seen(spark, d):
    return gradients.first_seen(gradients.edges(_indexed(spark, d)[0], EDGE))


def _flat(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The decoded index matrix, written once as it is read several times, and its palette."""
    ix, palette = _indexed(spark, d)
    return settled(quantize.decoded(ix, palette)), palette


def _segments(spark, d):
    flat, _ = _flat(spark, d)
    edge = gradients.edges(flat, EDGE)
    return flat, edge, gradients.segments(edge, flat, SEGMENT)


def segments(spark, d):
    return _segments(spark, d)[2].select("image_id", "lo", "hi", "seg", "n", "first_x", "first_y", "direction")


def segment_shapes(spark, d):
    return _segments(spark, d)[2].select("image_id", "lo", "hi", "seg", "shape", "direction", "width")


def change_points(spark, d):
    return gradients.descriptors(_segments(spark, d)[2], 0.25)


def change_points_strict(spark, d):
    """Segments of two edges and a threshold that only two changed fields reach."""
    flat, _ = _flat(spark, d)
    return gradients.descriptors(gradients.segments(gradients.edges(flat, EDGE), flat, 2), 1.2)


def change_points_first(spark, d):
    """The first encoder's rules: no diagonal samples, widths as found, and no change for a direction alone."""
    flat, _ = _flat(spark, d)
    return gradients.descriptors(gradients.segments(gradients.edges(flat, EDGE, False), flat, 4, False), 1.0, False)


def apply_gradients(spark, d):
    flat, edge, seg = _segments(spark, d)
    return gradients.blended(flat, settled(edge.select("image_id", "lo", "hi", "edge_seq")), settled(gradients.descriptors(seg, 0.25)), EDGE).select("image_id", "y", "x", *_r("recon"))


def apply_gradients_along(spark, d):
    """The legacy decoder's rule: blended along the stored direction over the whole width."""
    flat, edge, seg = _segments(spark, d)
    return gradients.blended_along(flat, settled(edge.select("image_id", "lo", "hi", "edge_seq")), settled(gradients.descriptors(seg, 0.25)), EDGE).select("image_id", "y", "x", *_r("recon"))


def reconstruct(spark, d):
    return layers.reconstruct(R.planes_of_embeddings(spark, d), EPS, STEPS, EDGE, 0.02).select("image_id", "y", "x", *_r("base", "recon"))


def reconstruct_scaled(spark, d):
    """Residuals are quantised at four times their size."""
    return layers.reconstruct(R.planes_of_embeddings(spark, d), EPS, STEPS, EDGE, 0.04, 4.0).select("image_id", "y", "x", *_r("base", "recon"))


def reconstruct_channels(spark, d):
    """Each channel of Lab images as a base layer and a residual layer."""
    planes = layers.folded(layers.stacked(_lab(R.rgb_of_embeddings(spark, d))))
    return layers.unfolded(layers.reconstruct(planes, 5.0, STEPS, 8, 3.0)).select("image_id", "channel", "y", "x", *_r("base", "recon", digits=5))


def reconstruct_rgb(spark, d):
    """As reconstruct_channels, the three channels brought together and turned back to bytes."""
    t = layers.unfolded(layers.reconstruct(layers.folded(layers.stacked(_lab(R.rgb_of_embeddings(spark, d)))), 5.0, STEPS, 8, 3.0))
    t = t.groupBy("image_id", "y", "x").pivot("channel", list(layers.CHANNELS)).agg(F.first("recon"))
    return t.select("image_id", "y", "x", *(F.expr(e).alias(n) for e, n in zip(scalar.rgb(), "rgb", strict=True)))


def layer_sum(spark, d):
    """Base values plus a residual layer that only every second image has."""
    pairs = _pairs(spark, d)
    rest = pairs.where("image_id % 2 = 0").select("image_id", "y", "x", (F.col("p") - F.col("q")).alias("v"))
    return layers.summed(pairs.select("image_id", "y", "x", F.col("q").alias("v")), [rest]).select("image_id", "y", "x", *_r("v"))


def pyramid(spark, d):
    return layers.pyramid(R.planes_of_embeddings(spark, d), EPS, STEPS, EDGE, EDGE, 0.02).select("image_id", "y", "x", *_r("recon"))


def subsample_short(spark, d):
    """Odd places, without the last one of an even side."""
    return stencil.subsample(R.planes_of_embeddings(spark, d), "v", size=(8, 8)).select("image_id", "y", "x", *_r("v"))


def resized(spark, d):
    return stencil.resized(R.planes_of_embeddings(spark, d), (8, 8), 5, 11).select("image_id", "y", "x", *_r("v"))


def resize_error(spark, d):
    """What halving the size and doubling it again loses."""
    planes = R.planes_of_embeddings(spark, d)
    back = stencil.resized(stencil.resized(planes, (8, 8), 4, 4), (4, 4), 8, 8)
    return stencil.mse_psnr(stencil.aligned(planes, back), 1.0).select("image_id", *_r("mse", digits=9), *_r("psnr", digits=5))


def first_samples(spark, d):
    return stencil.first_samples(_pairs(spark, d).select("image_id", "y", "x", F.col("q").alias("v")), 5).select("image_id", "nth", *_r("v"))


def palette_errors(spark, d):
    planes = R.planes_of_embeddings(spark, d)
    return quantize.error_summary(quantize.direct(planes, EPS), planes).select("image_id", *_r("mean_error", "worst_error", "reduction"), "index_bits")


def channel_plane(spark, d):
    """One channel of stacked Lab planes."""
    return layers.channel_of(layers.stacked(_lab(R.rgb_of_embeddings(spark, d))), "a").select("image_id", "y", "x", *_r("v", digits=5))


def lab_mse(spark, d):
    """Each Lab channel's error of images whose bytes were cut to four bits."""
    px = R.rgb_of_embeddings(spark, d)
    cut = px.select("image_id", "y", "x", *(F.expr(f"{c} div 16 * 16 + 8").cast("int").alias(c) for c in "rgb"))
    side = lambda t, n: layers.stacked(_lab(t)).withColumnRenamed("v", n)
    return stencil.channel_mse(side(px, "p").join(side(cut, "q"), ["image_id", "channel", "y", "x"])).select("image_id", "channel", *_r("mse", digits=5))


def _bucket_colours(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lab pixels with their 3-D bucket as cluster, and the clusters' mean colours and errors."""
    ix = settled(quantize.numbered_voxels(settled(quantize.voxelled(_lab(R.rgb_of_embeddings(spark, d)), (20.0, 20.0, 20.0)))))
    return ix, quantize.colour_palette(ix)


def noise_uniform(spark, d):
    return noise.between(*_bucket_colours(spark, d), 7).select("image_id", "y", "x", *_r("l", "a", "b", digits=5))


def noise_border(spark, d):
    ix, palette = _bucket_colours(spark, d)
    return noise.between(ix, palette, 7, stencil.near_boundary(ix, 1)).select("image_id", "y", "x", *_r("l", "a", "b", digits=5))


def noise_normal(spark, d):
    return noise.around_middle(*_bucket_colours(spark, d), 7).select("image_id", "y", "x", *_r("l", "a", "b", digits=5))


def similar_border_blur(spark, d):
    flat, _ = _flat(spark, d)
    planes = flat.withColumn("v", F.floor((F.col("v") + 0.6) * 200).cast("double"))
    return stencil.similar_border_blur(planes, ("recon",), 2, 0.12).select("image_id", "y", "x", "v")


def similar_colours(spark, d):
    return stencil.similar_pairs(_bucket_colours(spark, d)[1], 30.0, ("l", "a", "b"))


def upsample_index_older(spark, d):
    flat, palette = _flat(spark, d)
    return resample.upsample_index_older(stencil.subsample(flat, "idx", odd=False), palette, 7, 8)


def image_scan(spark, d):
    """Images written as PNG files and scanned by Spark's image source."""
    folder = container.write_png_files(container.write_png(R.rgb_of_embeddings(spark, d)), shared_folder(spark, "png"))
    return R.image_pixels(spark.read.format("image").load(folder))


def subsample_odd(spark, d):
    return stencil.subsample(R.planes_of_embeddings(spark, d), "v").select("image_id", "y", "x", *_r("v"))


def subsample_even(spark, d):
    return stencil.subsample(R.planes_of_embeddings(spark, d), "v", odd=False).select("image_id", "y", "x", *_r("v"))


def upsample_nearest(spark, d):
    return stencil.upsample_nearest(stencil.subsample(R.planes_of_embeddings(spark, d), "v"), "v", 8, 8).select("image_id", "y", "x", *_r("v"))


def _upsampled(spark, d, odd: bool) -> DataFrame:
    ix, palette = _flat(spark, d)
    return resample.upsample_index(stencil.subsample(ix, "idx", odd=odd), palette, 8, 8, odd)


def upsample_index_odd(spark, d):
    return _upsampled(spark, d, True)


def upsample_index_even(spark, d):
    return _upsampled(spark, d, False)


def _colour_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The index matrix of Lab images and its palette: image_id, idx, l, a, b, error.

    Pixels with their buckets are written once, as are their clusters: both are read several times, and tests for
    null that joins push down would otherwise repeat the colour formulas below every projection.
    """
    lab = settled(quantize.voxelled(_lab(R.rgb_of_embeddings(spark, d)), (5.0, 5.0, 5.0)))
    clusters = quantize.cover(lab.select("image_id", "kl", "ka", "kb").distinct(), 2).withColumnRenamed("cluster", "idx")
    ix = settled(lab.join(clusters, ["image_id", "kl", "ka", "kb"]))
    return ix, quantize.colour_palette(ix)


def upsample_index_box(spark, d):
    ix, palette = _colour_index(spark, d)
    return resample.upsample_index(stencil.subsample(ix, "idx"), palette, 8, 8, nearest=resample.nearest_in_box)


def colour_palette(spark, d):
    return _colour_index(spark, d)[1].select("image_id", "idx", *_r("l", "a", "b", "error", digits=5))


def container_first(spark, d):
    return older.read_older(older.write_older(*_colour_index(spark, d), 1), 1)


def container_second(spark, d):
    return older.read_older(older.write_older(*_colour_index(spark, d), 2), 2)


def _as_colours(palette: DataFrame) -> DataFrame:
    """A plane's palette as colours without chroma, as the older containers hold palettes."""
    return palette.select("image_id", "idx", (F.col("value") * 100).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("error"))


def container_dct(spark, d):
    """Kept coefficients in reduced files of the first version, read again."""
    flat, palette = _flat(spark, d)
    kept = stencil.keep_coefficients(stencil.dct(R.planes_of_embeddings(spark, d), 4, 5), 4, 5, 0.05)
    files = older.write_older(stencil.subsample(flat, "idx"), _as_colours(palette), 1, kept=kept, dct=(4, 5, 0.05), full=(8, 8))
    return older.read_coefficients(files, 8, True)


def container_older_queue(spark, d):
    """Descriptors of both older versions, the second with two layers, read again."""
    flat, palette = _flat(spark, d)
    queue = settled(gradients.descriptors(gradients.segments(gradients.edges(flat, EDGE), flat, SEGMENT), 0.25))
    twice = lambda t: t.withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
    one = older.read_older_queue(older.write_older(flat, _as_colours(palette), 1, queue), 1)
    two = older.read_older_queue(older.write_older(twice(flat), twice(_as_colours(palette)), 2, twice(queue), 6), 2)
    return one.selectExpr("1 version", "*").unionByName(two.selectExpr("2 version", "*"))


def format_scan(spark, d):
    """Images in four formats that Spark's image source doesn't read, by image_id, scanned as binary files' bytes."""
    files = formats.write_files(R.rgb_of_embeddings(spark, d))
    return formats.read_files(files, "image_id", "data")


def nearest_palette(spark, d):
    ix, palette = _indexed(spark, d)
    pairs = gradients.first_seen(gradients.edges(ix, EDGE)).select("image_id", F.col("lo").alias("a"), F.col("hi").alias("b"))
    return stencil.nearest_to_midpoint(pairs, palette)


def similar_pairs(spark, d):
    return stencil.similar_pairs(_indexed(spark, d)[1], 0.2)


def dct_block(spark, d):
    t = stencil.dct(R.planes_of_embeddings(spark, d), 8)
    return t.select("image_id", F.expr("cast(p div 8 as int)").alias("u"), (F.col("p") % 8).alias("w"), F.round("c", 6).alias("c"))


def dct_topk(spark, d):
    return stencil.keep_coefficients(stencil.dct(R.planes_of_embeddings(spark, d), 8, 6), 8, 6, 0.05).select("image_id", "k", "q")


def idct_roundtrip(spark, d):
    return stencil.idct(stencil.dct(R.planes_of_embeddings(spark, d), 8), 8).select("image_id", "y", "x", *_r("v"))


def dct_residual(spark, d):
    kept = stencil.keep_coefficients(stencil.dct(R.planes_of_embeddings(spark, d), 8, 6), 8, 6, 0.05)
    return stencil.restored_residual(kept, 8, 0.05, 2.5).select("image_id", "y", "x", *_r("v"))


def deblock(spark, d):
    return stencil.deblocked(R.planes_of_embeddings(spark, d), 4, 2, 0.5).select("image_id", "y", "x", *_r("v"))


def _grey(spark, d):
    return R.raster_of_lineitem(spark, d).select("image_id", "y", "x", F.col("r").cast("double").alias("v"))


def gauss3(spark, d):
    return stencil.gauss3(_grey(spark, d)).select("image_id", "y", "x", *_r("g"))


def median3(spark, d):
    return stencil.median3(_grey(spark, d))


def bilateral(spark, d):
    return stencil.bilateral(_grey(spark, d))


def soft_lowpass(spark, d):
    return stencil.soft_lowpass(R.planes_of_embeddings(spark, d)).select("image_id", "y", "x", *_r("s"))


def region_blur(spark, d):
    ix, _ = _indexed(spark, d)
    return stencil.region_blur(ix.withColumn("v", F.floor((F.col("v") + 0.6) * 200).cast("double"))).select("image_id", "y", "x", "v")


def near_boundary(spark, d):
    return stencil.near_boundary(_indexed(spark, d)[0], 1)


def mse_psnr(spark, d):
    return stencil.mse_psnr(_pairs(spark, d)).select("image_id", *_r("mse", digits=9), *_r("psnr", digits=5))


def ssim(spark, d):
    return stencil.ssim(_pairs(spark, d)).select("image_id", *_r("ssim"))


def difference_map(spark, d):
    return stencil.difference_map(_pairs(spark, d)).select("image_id", "y", "x", *_r("d", digits=4))


def bfs3d(spark, d):
    return quantize.cover(quantize.voxels(_lab(R.raster_of_lineitem(spark, d)), (5.0, 5.0, 5.0)), 2)


def container_roundtrip(spark, d):
    ix, palette = _indexed(spark, d)
    return container.read_container(container.write_container(ix, palette))


def png_files(spark, d):
    return container.write_png(R.rgb_of_embeddings(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        quantised_run_statistics, lab_convert, lab_roundtrip, lab_roundtrip_legacy, voxel_agg, quantize_bfs1d, quantize_direct, signal_palette, palette_decode, residual_plane, cluster_error, plane_ranges, half_float, descriptor_codes, descriptor_fields, easing,
        med_encode, med_decode, rle, rle_roundtrip, run_key_freq, huffman_codes, huffman_bits, size_report, edges, pair_first_seen, segments, segment_shapes, change_points, change_points_strict, change_points_first, apply_gradients, reconstruct, pyramid,
        subsample_odd, subsample_even, upsample_nearest, upsample_index_odd, upsample_index_even, upsample_index_box, nearest_palette, similar_pairs, dct_block, dct_topk, idct_roundtrip, dct_residual, deblock, gauss3, median3, bilateral, soft_lowpass, region_blur, near_boundary, mse_psnr, ssim, difference_map, container_layers, container_queue, container_reduced, container_dct, container_older_queue, apply_gradients_along, reconstruct_scaled, reconstruct_channels, reconstruct_rgb, layer_sum, subsample_short, resized, resize_error, first_samples, palette_errors, channel_plane, lab_mse, noise_uniform, noise_border, noise_normal, similar_border_blur, similar_colours, upsample_index_older, image_scan, format_scan, bfs3d, colour_palette, container_first, container_second, container_roundtrip, png_files,
    )
}

_LABS = f"lb as {twins.lab('rgb')}"
_DECODE = "select ix.image_id, y, x, v, value as q from ix join pal using (image_id, idx)"
_DCT = "cs as (select u, i, sqrt((case when u = 0 then 1 else 2 end) / 8.0) * cos(pi() * (2 * i + 1) * u / 16.0) as w from range(8) a(u), range(8) b(i)), co as (select image_id, a.u, b.u as w, sum(v * a.w * b.w) as c from px join cs a on a.i = y join cs b on b.i = x group by all)"
_CLAMP = "(select a.image_id, a.y, a.x, a.r as own, o.dy, o.dx, b.r as v from big a, lim l, (select i - {r} as dy, j - {r} as dx from range({n}) s(i), range({n}) t(j)) o, big b where b.y = least(l.my, greatest(0, a.y + o.dy)) and b.x = least(l.mx, greatest(0, a.x + o.dx)))"
_ZZ = "zz as (select r, c, cast(row_number() over (order by r + c, case when (r + c) % 2 = 1 then r else c end) - 1 as int) as k from range(8) a(r), range(8) b(c))"



def _upsample_sql(first: int) -> str:
    def filled(out: str, source: str, axis: str, other: str) -> str:
        at = f"2 * s.{axis} + {first}"
        part = ", ".join(f"max(case when {at} = g.p + {d} then s.idx end) as {n}" for d, n in ((0, "own"), (-1, "p"), (1, "q")))
        return f"{out}0 as (select s.image_id, s.{other}, g.p as {axis}, {part} from {source} s join range(8) g(p) on abs({at} - g.p) <= 1 group by s.image_id, s.{other}, g.p), {out} as (select t.image_id, y, x, coalesce(own, near.idx) as idx from {out}0 t left join near on near.image_id = t.image_id and near.a = coalesce(p, q) and near.b = coalesce(q, p))"

    near = "near as (select a.image_id, a.idx as a, b.idx as b, c.idx from pal a join pal b using (image_id) join pal c using (image_id) qualify row_number() over (partition by a.image_id, a.idx, b.idx order by round(abs(c.value - (a.value + b.value) / 2), 9), c.idx) = 1)"
    small = f"small as (select image_id, y // 2 as y, x // 2 as x, idx from ix where y % 2 = {first} and x % 2 = {first})"
    return f"{BASE}, {near}, {small}, {filled('wide', 'small', 'x', 'y')}, {filled('tall', 'wide', 'y', 'x')} select image_id, cast(y as int) as y, cast(x as int) as x, idx from tall"


ORACLE: dict[str, str] = {
    "upsample_index_odd": _upsample_sql(1),
    "upsample_index_even": _upsample_sql(0),
    "quantised_run_statistics": f"{BASE}, {MED}, {RUNS} select image_id, count(*) as n_runs, max(len) as max_run, cast(sum(len) as bigint) as pixels, any_value(size)::bigint as palette_size from runs join sz using (image_id) group by image_id",
    "lab_convert": f"with {RGB}, {_LABS} select image_id, y, x, round(l, 5) as l, round(a, 5) as a, round(b, 5) as b from lb",
    "lab_roundtrip": f"with {RGB}, {_LABS} select image_id, y, x, r, g, b from {twins.rgb('lb')}",
    "lab_roundtrip_legacy": f"with {RGB}, {_LABS} select image_id, y, x, r, g, b from {twins.rgb('lb', True)}",
    "voxel_agg": f"with {BIG}, lb as {twins.lab('big', 'image_id')} select image_id, cast(floor(l / 5.0) as int) as kl, cast(floor(a / 5.0) as int) as ka, cast(floor(b / 5.0) as int) as kb, count(*) as n, round(sum(l), 4) as sum_l, round(sum(a), 4) as sum_a, round(sum(b), 4) as sum_b from lb group by 1, 2, 3, 4",
    "quantize_bfs1d": f"{BASE} select image_id, idx, round(value, 6) as value, n from pal",
    "quantize_direct": f"with {PX} select image_id, k, cast(dense_rank() over (partition by image_id order by k) - 1 as int) as idx, round(m, 6) as value, round(greatest(m - lo, hi - m), 6) as error, n from (select image_id, cast(floor(v / {EPS}) as int) as k, avg(v) as m, min(v) as lo, max(v) as hi, count(*) as n from px group by all)",
    "signal_palette": f"with {SIG} select image_id, k, cast(dense_rank() over (partition by image_id order by k) - 1 as int) as idx, round(m, 6) as value, round(greatest(m - lo, hi - m), 6) as error, n from (select image_id, cast(floor(v / 25.0) as int) as k, avg(v) as m, min(v) as lo, max(v) as hi, count(*) as n from sig group by all)",
    "palette_decode": f"{BASE} select image_id, y, x, round(q, 6) as recon from ({_DECODE})",
    "residual_plane": f"{BASE} select image_id, y, x, round(v - q, 6) as residual from ({_DECODE})",
    "cluster_error": f"{BASE} select ix.image_id, ix.idx, round(max(abs(v - value)), 6) as error from ix join pal using (image_id, idx) group by all",
    "plane_ranges": f"with {PX} select image_id, round(min(v), 6) as lo, round(max(v), 6) as hi, round(avg(abs(v)), 6) as mean_abs from px group by all",
    "half_float": f"with {PX}, m as (select *, abs(v) as m, cast(floor(log2(nullif(abs(v), 0))) as int) as e from px) select image_id, y, x, round(case when m < power(2.0, -14) then 0.0 else sign(v) * floor(m * power(2.0, 10 - e)) / power(2.0, 10 - e) end, 9) as h from m",
    "descriptor_codes": f"with {RGB}, t as (select image_id, y, x, r % 4 as s, g % 4 as d, b % 4 as w from rgb) select image_id, y, x, w as code2, s as old2, cast(w * 4 + s as int) as code4, cast(s * 4 + d as int) as old4, cast(s * 16 + d * 4 + w as int) as code6, cast(s * 16 + d * 4 + w as int) as old6 from t",
    "easing": f"with {PX}, t as (select *, least(1.0, greatest(0.0, v + 0.5)) as t from px) select image_id, y, x, case when t < 0.5 then 0.0::double else 1.0::double end as s0, round(t, 6) as s1, round(case when t < 0.5 then 2 * t * t else 1 - power(2 - 2 * t, 2) / 2 end, 6) as s2, round(3 * t * t - 2 * t * t * t, 6) as s3 from t",
    "med_encode": f"{BASE}, {MED} select * from med",
    "med_decode": f"{BASE} select image_id, y, x, idx from ix",
    "rle": f"{BASE}, {MED}, {RUNS} select image_id, run_no, value, len from runs",
    "rle_roundtrip": f"{BASE}, {MED} select image_id, y, x, e as value from med",
    "run_key_freq": f"{BASE}, {MED}, {RUNS}, {KEYS} select * from keys",
    "edges": f"{BASE}, {EDGES} select image_id, cast(edge_seq as bigint) as edge_seq, x, y, ca, cb, lo, hi, 2 + (select count(*) from ix s where s.image_id = ed.image_id and s.y = ed.ny and s.x between ed.x - 1 and ed.x + 1 and s.idx = ed.cb) as n_samples from ed",
    "pair_first_seen": f"{BASE}, {EDGES}, f as (select image_id, lo, hi, min(edge_seq) as first_seq from ed group by all) select image_id, lo, hi, cast(first_seq as bigint) as first_seq, row_number() over (partition by image_id order by first_seq) - 1 as pair_no from f",
    "segments": f"{BASE}, {EDGES}, n as (select *, cast((row_number() over (partition by image_id, lo, hi order by edge_seq) - 1) // {SEGMENT} as int) as seg from ed), g as (select image_id, lo, hi, seg, count(*) as n, arg_min(x, edge_seq) as first_x, arg_min(y, edge_seq) as first_y, arg_max(x, edge_seq) as last_x, arg_max(y, edge_seq) as last_y, max(x) - min(x) as sx, max(y) - min(y) as sy from n group by image_id, lo, hi, seg) select image_id, lo, hi, seg, n, first_x, first_y, case when n < 2 then 0 when sx > 2 * sy then 0 when sy > 2 * sx then 1 when (last_x - first_x) * (last_y - first_y) >= 0 then 2 else 3 end as direction from g",
    "subsample_odd": f"with {PX} select image_id, cast(y // 2 as int) as y, cast(x // 2 as int) as x, round(v, 6) as v from px where x % 2 = 1 and y % 2 = 1",
    "subsample_even": f"with {PX} select image_id, cast(y // 2 as int) as y, cast(x // 2 as int) as x, round(v, 6) as v from px where x % 2 = 0 and y % 2 = 0",
    "upsample_nearest": f"with {PX} select p.image_id, g.y, g.x, round(p.v, 6) as v from (select cast(i as int) as y, cast(j as int) as x, greatest(0, i - 1) // 2 as sy, greatest(0, j - 1) // 2 as sx from range(8) a(i), range(8) b(j)) g join px p on p.y = 2 * g.sy + 1 and p.x = 2 * g.sx + 1",
    "nearest_palette": f"{BASE}, {EDGES}, q as (select distinct image_id, lo, hi from ed), m as (select q.image_id, lo, hi, (a.value + b.value) / 2 as mid from q join pal a on a.image_id = q.image_id and a.idx = lo join pal b on b.image_id = q.image_id and b.idx = hi) select m.image_id, lo as a, hi as b, idx from m join pal p using (image_id) qualify row_number() over (partition by m.image_id, lo, hi order by round(abs(p.value - mid), 9), idx) = 1",
    "similar_pairs": f"{BASE} select a.image_id, a.idx as a, b.idx as b from pal a join pal b on a.image_id = b.image_id and a.idx < b.idx where abs(a.value - b.value) < 0.2",
    "dct_block": f"with {PX}, {_DCT} select image_id, cast(u as int) as u, cast(w as int) as w, round(c, 6) as c from co",
    "dct_topk": f"with {PX}, {_DCT}, {_ZZ} select image_id, k, cast(greatest(-127, least(127, round(co.c / 0.05))) as int) as q from co join zz on zz.r = u and zz.c = w where k < 6",
    "idct_roundtrip": f"with {PX} select image_id, y, x, round(v, 6) as v from px",
    "gauss3": f"with {BIG}, lim as (select max(y) as my, max(x) as mx from big) select image_id, y, x, round(sum(v * (2 - abs(dy)) * (2 - abs(dx)) / 16.0), 6) as g from {_CLAMP.format(r=1, n=3)} group by image_id, y, x",
    "median3": f"with {BIG}, lim as (select max(y) as my, max(x) as mx from big) select image_id, y, x, cast(list_sort(list(v))[5] as double) as m from {_CLAMP.format(r=1, n=3)} group by image_id, y, x",
    "bilateral": f"with {BIG}, lim as (select max(y) as my, max(x) as mx from big), n as (select *, exp(-(dx * dx + dy * dy) / 50.0 - (v - own) * (v - own) / 50.0) as w from {_CLAMP.format(r=2, n=5)}) select image_id, y, x, cast(floor(sum(w * v) / sum(w) + 1e-9) as int) as f from n group by image_id, y, x",
    "soft_lowpass": f"with {PX}, n as (select a.image_id, a.y, a.x, a.v as own, b.v, exp(-((b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x)) / 1.125) as w from px a join px b on a.image_id = b.image_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1) select image_id, y, x, round(any_value(own) * 0.8 + sum(w * v) / sum(w) * 0.2, 6) as s from n group by image_id, y, x",
    "near_boundary": f"{BASE} select image_id, y, x from ix a where exists (select 1 from ix b where b.image_id = a.image_id and abs(a.y - b.y) + abs(a.x - b.x) = 1 and a.idx <> b.idx)",
    "mse_psnr": f"{BASE}, e as (select image_id, avg(power(v - q, 2)) as mse from ({_DECODE}) group by all) select image_id, round(mse, 9) as mse, round(10 * log10(65025 / mse), 5) as psnr from e",
    "ssim": f"{BASE}, t as ({_DECODE}), w as (select c.image_id, c.y, c.x, avg(n.v) as up, avg(n.q) as uq, var_samp(n.v) as sp, var_samp(n.q) as sq, covar_samp(n.v, n.q) as pq from t c join t n on n.image_id = c.image_id and abs(n.y - c.y) <= 3 and abs(n.x - c.x) <= 3 where c.y between 3 and 4 and c.x between 3 and 4 group by all) select image_id, round(avg((2 * up * uq + 0.0001) * (2 * pq + 0.0009) / ((up * up + uq * uq + 0.0001) * (sp + sq + 0.0009))), 6) as ssim from w group by image_id",
    "difference_map": f"{BASE}, t as (select *, abs(v - q) as a from ({_DECODE})), l as (select image_id, min(a) as lo, max(a) as hi from t group by all) select image_id, y, x, round((a - lo) * 255 / (hi - lo), 4) as d from t join l using (image_id)",
}

#: One layer over px, which also has the steps before blending; two layers; and their inputs.
_BASE = f"{PX}, {twins.palette('t', 'px', EPS, STEPS)}, {twins.descriptors('t', EDGE, SEGMENT, 0.25)}"
_TWO = f"{PX}, {twins.two_layers('t', 'px', EPS, STEPS, EDGE, 0.02)}"
_CHANNELS = f"{RGB}, {_LABS}, pl as (select image_id * 3 + c as image_id, y, x, [l, a, b][c + 1] as v from lb, range(3) r(c)), {twins.two_layers('t', 'pl', 5.0, STEPS, 8, 3.0)}"
_QUEUE = "image_id, queue_idx, lo, hi, first_x, first_y, shape, direction, width, change"
_VOXELS = f"{RGB}, {_LABS}, vx as (select image_id, y, x, l, a, b, cast(floor(l / 20) as int) as kl, cast(floor(a / 20) as int) as ka, cast(floor(b / 20) as int) as kb from lb), vi as (select *, cast(dense_rank() over (partition by image_id order by kl, ka, kb) - 1 as int) as idx from vx), vm as (select image_id, idx, avg(l) as cl, avg(a) as ca, avg(b) as cb from vi group by all), vp as (select image_id, idx, cl, ca, cb, max(sqrt(power(l - cl, 2) + power(a - ca, 2) + power(b - cb, 2))) as radius from vi join vm using (image_id, idx) group by all)"
_PLACED = "select image_id, y, x, round(cl + f * ml, 5) as l, round(ca + f * ma, 5) as a, round(cb + f * mb, 5) as b from (select *, case when sqrt(ml * ml + ma * ma + mb * mb) > radius then radius / sqrt(ml * ml + ma * ma + mb * mb) else 1 end as f from w)"
_COLOURS = f"{RGB}, {_LABS}, vx as (select image_id, y, x, l, a, b, cast(floor(l / 5) as int) as kl, cast(floor(a / 5) as int) as ka, cast(floor(b / 5) as int) as kb from lb), {twins.cover('vx', 2)}, ci as (select p.*, c.cluster::int as idx from vx p join cv c on c.image_id = p.image_id and c.v.kl = kl and c.v.ka = ka and c.v.kb = kb), cm as (select image_id, idx, avg(l) as ml, avg(a) as ma, avg(b) as mb from ci group by all), cp as (select image_id, idx, ml as l, ma as a, mb as b, max(sqrt(power(i.l - ml, 2) + power(i.a - ma, 2) + power(i.b - mb, 2))) as error from ci i join cm using (image_id, idx) group by all)"
_KINDS = f"{BASE}, {MED}, {RUNS}, {KEYS}, {twins.huffman('keys')}"


def _noise(share: str, more: str = "") -> str:
    return f"with {_VOXELS}{more}, w as (select *, {share} * (l - cl) as ml, {share} * (a - ca) as ma, {share} * (b - cb) as mb from vi join vp using (image_id, idx)) {_PLACED}"


_U = twins.uniform(7, ("image_id", "y", "x"))
_NEAR = ", nb as (select p.image_id, p.y, p.x, exists (select 1 from vi q where q.image_id = p.image_id and abs(q.y - p.y) + abs(q.x - p.x) = 1 and q.idx <> p.idx) as near from vi p)"


def _box_sql() -> str:
    """Odd samples of the colour matrix brought up again: a gap takes the colour nearest to the middle in the neighbours' box."""
    near = """near as (select p.image_id, p.idx as a, q.idx as b, n.idx from cp p join cp q using (image_id) join cp n using (image_id) where """ + " and ".join(f"n.{c} between least(p.{c}, q.{c}) - 5 and greatest(p.{c}, q.{c}) + 5" for c in "lab") + " qualify row_number() over (partition by p.image_id, p.idx, q.idx order by round(" + " + ".join(f"(n.{c} - (p.{c} + q.{c}) / 2) * (n.{c} - (p.{c} + q.{c}) / 2)" for c in "lab") + ", 6), case when n.idx = p.idx then 0 when n.idx = q.idx then 1 else n.idx + 2 end) = 1)"
    small = "small as (select image_id, y // 2 as y, x // 2 as x, idx from ci where y % 2 = 1 and x % 2 = 1)"

    def filled(out: str, source: str, axis: str, other: str) -> str:
        part = ", ".join(f"max(case when 2 * s.{axis} + 1 = g.p + {d} then s.idx end) as {n}" for d, n in ((0, "own"), (-1, "p"), (1, "q")))
        return f"{out}0 as (select s.image_id, s.{other}, g.p as {axis}, {part} from {source} s join range(8) g(p) on abs(2 * s.{axis} + 1 - g.p) <= 1 group by s.image_id, s.{other}, g.p), {out} as (select t.image_id, y, x, coalesce(own, case when p is null then q when q is null then p when p = q then p end, near.idx) as idx from {out}0 t left join near on near.image_id = t.image_id and near.a = p and near.b = q)"

    return f"with recursive {_COLOURS}, {near}, {small}, {filled('wide', 'small', 'x', 'y')}, {filled('tall', 'wide', 'y', 'x')} select image_id, cast(y as int) as y, cast(x as int) as x, idx from tall"


def _older_sql() -> str:
    """Even samples of a 7 x 8 matrix brought up by the oldest rule."""
    near = "near as (select a.image_id, a.idx as a, b.idx as b, c.idx from pal a join pal b using (image_id) join pal c using (image_id) qualify row_number() over (partition by a.image_id, a.idx, b.idx order by round(abs(c.value - (a.value + b.value) / 2), 9), c.idx) = 1)"
    wide = "wide as (select s.image_id, s.y // 2 as y, g.x, case when g.x % 2 = 0 then max(case when s.x = g.x then s.idx end) when max(case when s.x = g.x - 1 then s.idx end) = max(case when s.x = g.x + 1 then s.idx end) then max(case when s.x = g.x - 1 then s.idx end) else max(n.idx) end as idx from range(7) g(x) join ix s on s.y % 2 = 0 and s.x % 2 = 0 and abs(s.x - g.x) <= 1 left join ix o on o.image_id = s.image_id and o.y = s.y and o.x = g.x + 1 and s.x = g.x - 1 and g.x % 2 = 1 left join near n on n.image_id = s.image_id and n.a = s.idx and n.b = o.idx group by s.image_id, s.y, g.x)"
    side = "side as (select image_id, y, x, idx from wide where x < 6 union all select image_id, y, 6, idx from wide where x = 5)"
    tall = "select a.image_id, cast(g.y as int) as y, cast(a.x as int) as x, cast(case when g.y = 7 then 0 when g.y % 2 = 0 then a.idx when a.idx = b.idx then a.idx else n.idx end as int) as idx from range(8) g(y) join side a on a.y = g.y // 2 left join side b on b.image_id = a.image_id and b.x = a.x and b.y = g.y // 2 + 1 left join near n on n.image_id = a.image_id and n.a = a.idx and n.b = b.idx"
    return f"{BASE}, {near}, {wide}, {side} {tall}"


def _resized_sql(source: str, out: str, n: tuple[int, int], size: tuple[int, int]) -> str:
    def taps(name: str, n: int, out: int) -> str:
        return f"{name} as (select k, i, case when i = floor(p) then 1 - (p - floor(p)) else p - floor(p) end as w from (select k, least({n - 1}.0::double, greatest(0.0, (k + 0.5) * {n} / {out}.0::double - 0.5)) as p from range({out}) r(k)), range({n}) s(i) where i = floor(p) or i = floor(p) + 1 and p > floor(p))"

    return f"{taps(out + 'x', n[0], size[0])}, {taps(out + 'y', n[1], size[1])}, {out} as (select image_id, cast(b.k as int) as y, cast(a.k as int) as x, sum(v * a.w * b.w) as v from {source} s join {out}x a on a.i = s.x join {out}y b on b.i = s.y group by all)"


def _layer_size_sql(n: str, group: str, source: str) -> str:
    """{n}s: the sections of a layer whose steps are named {n}."""
    med = MED.replace("from ix)", f"from {n}_ix)").replace("from pal ", f"from {n}_pal ")
    steps = f"{med}, {RUNS}, {KEYS}, {twins.huffman('keys')}"
    for name in ("nb", "nc", "sz", "med", "sq", "ch", "rn", "runs", "mx", "keys", "hs", "hr", "hf"):
        steps = _renamed(steps, name, f"{n}{name}")
    bits = f"{n}bits as (select h.image_id, any_value(entries) as entries, sum(freq * length(c.code)) as bits, any_value(entries) = 1 as alone from {n}hf h join {n}keys k on k.image_id = h.image_id and k.key = c.key group by h.image_id)"
    queue = f"{n}qu as (select image_id, (count(*) * 2 + 7) // 8 + 8 * count(*) filter (where change) as b from {n}_ds group by all)"
    part = f"{n}s as (select image_id, '{group}' as g, unnest(['palette', 'fields', 'table', 'runs', 'gradients']) as s, unnest([p, 18, 9 * entries, ((case when alone then (select sum(freq) from {n}keys k where k.image_id = t.image_id) else bits end) + 7) // 8, 13 + coalesce(b, 0)]) as b from (select image_id, 2 + 2 * count(*) as p from {n}_pal group by all) t join {n}bits using (image_id) left join {n}qu using (image_id))"
    return f"{steps}, {bits}, {queue}, {part}"


def _renamed(sql: str, name: str, new: str) -> str:
    """sql with a relation under another name, where it stands as a word of its own."""
    out, at = [], 0
    while (k := sql.find(name, at)) >= 0:
        around = sql[k - 1 : k] + sql[k + len(name) : k + len(name) + 1]
        alone = not any(c.isalnum() or c == "_" for c in around)
        out += [sql[at:k], new if alone else name]
        at = k + len(name)
    return "".join([*out, sql[at:]])


def _report_sql() -> str:
    sections = f"sections as (select * from tbs union all select * from trs union all select distinct image_id, 'HEADER', 'sizes', 8 from px)"
    return f"""with recursive {_TWO}, {_layer_size_sql('tb', 'BASE', 'px')}, {_layer_size_sql('tr', 'RESIDUAL', 't_res')}, {sections},
ru as (select image_id, coalesce(g, 'TOTAL') as section_group, coalesce(s, 'ALL') as section, cast(sum(b) as bigint) as bytes from sections group by grouping sets ((image_id), (image_id, g), (image_id, g, s))),
whole as (select image_id, bytes as w from ru where section_group = 'TOTAL')
select image_id, section_group, section, bytes, round(8.0 * bytes / 64, 4) as bits_a_pixel, round(100.0 * bytes / w, 4) as percent, round(24.0 * 64 / (8.0 * bytes), 4) as ratio from ru join whole using (image_id)"""


def _blur_sql() -> str:
    """Pixels near borders of similar clusters, blurred with radius 2."""
    return f"""{BASE}, bp as (select i.image_id, y, x, i.idx, floor((v + 0.6) * 200) as v, value as recon from ix i join pal using (image_id, idx)),
bn as (select distinct a.image_id, a.y, a.x from bp a join bp b on b.image_id = a.image_id and abs(a.y - b.y) + abs(a.x - b.x) = 1 and a.idx <> b.idx and abs(a.recon - b.recon) < 0.12),
bm as (select distinct p.image_id, p.y, p.x from bp p join bn on bn.image_id = p.image_id and abs(bn.y - p.y) <= 2 and abs(bn.x - p.x) <= 2),
bw as (select p.image_id, p.y, p.x, sum(q.v * w) / sum(w) as soft from bm p, {twins.gauss(2)}, bp q where q.image_id = p.image_id and q.y = p.y + dy and q.x = p.x + dx group by all)
select image_id, y, x, case when soft is null then v else floor(least(255, greatest(0, soft + 1e-9))) end as v from bp left join bw using (image_id, y, x)"""


def _container_sql() -> str:
    files = " union all ".join(f"select i.image_id, {tag} as layer, y, x, idx, value from {n}_ix i join {n}_pal p using (image_id, idx)" for n, tag in (("tb", 193), ("tr", 209)))
    return f"with {_TWO}, f as ({files}) select image_id, layer, y, x, idx, round({twins.half('value')}, 9) as value from f"


def _reduced_sql() -> str:
    parts = [f"select image_id, {193 + k} as layer, y // 2 as y, x // 2 as x, idx from ix where " + ("y % 2 = 1 and x % 2 = 1 and y < 7 and x < 7" if k == 0 else "y % 2 = 0 and x % 2 = 0") for k in range(3)]
    return f"{BASE}, f as ({' union all '.join(parts)} union all select image_id, 209, y, x, idx from ix) select image_id, layer, cast(y as int) as y, cast(x as int) as x, idx, round({twins.half('value')}, 9) as value from f join pal using (image_id, idx)"


_DCT_KEPT = f"with {PX}, {_DCT}, {_ZZ}, kept as (select image_id, u, co.w, greatest(-127, least(127, round(co.c / 0.05))) as q from co join zz on zz.r = u and zz.c = co.w where k < 6), {twins.idct('kept', 0.05)}"
_COLOUR_PIXELS = "select i.image_id, 0 as layer, y, x, idx, {} from ci i join cp p using (image_id, idx)"

ORACLE |= {
    "descriptor_fields": f"with {RGB}, t as (select image_id, y, x, cast(r % 4 as int) as s, cast(g % 4 as int) as d, cast(b % 4 as int) as w from rgb) select image_id, y, x, " + ", ".join(f"{e} as {k}_{f}" for k, own in (("new2", ("1", "0", "w")), ("old2", ("s", "0", "0")), ("new4", ("s", "0", "w")), ("old4", ("s", "d", "0")), ("new6", ("s", "d", "w")), ("old6", ("s", "d", "w"))) for f, e in zip(("shape", "direction", "width"), own, strict=True)) + " from t",
    "segment_shapes": f"with {_BASE} select image_id, lo, hi, seg, shape, direction, width from t_sg",
    "change_points": f"with {_BASE} select {_QUEUE} from t_ds",
    "change_points_strict": f"with recursive {PX}, {twins.palette('t', 'px', EPS, STEPS)}, {twins.descriptors('t', EDGE, 2, 1.2)} select {_QUEUE} from t_ds",
    "change_points_first": f"with recursive {PX}, {twins.palette('t', 'px', EPS, STEPS)}, {twins.descriptors('t', EDGE, 4, 1.0, True)} select {_QUEUE} from t_ds",
    "apply_gradients": f"with {_BASE}, {twins.blended('t', EDGE, False)} select image_id, y, x, round(recon, 6) as recon from t_out",
    "apply_gradients_along": f"with {_BASE}, {twins.blended('t', EDGE, False, True)} select image_id, y, x, round(recon, 6) as recon from t_out",
    "reconstruct": f"with {_TWO} select image_id, y, x, round(base, 6) as base, round(recon, 6) as recon from t",
    "reconstruct_scaled": f"with {PX}, {twins.two_layers('t', 'px', EPS, STEPS, EDGE, 0.04, 4.0)} select image_id, y, x, round(base, 6) as base, round(recon, 6) as recon from t",
    "reconstruct_channels": f"with {_CHANNELS} select image_id // 3 as image_id, ['l', 'a', 'b'][image_id % 3 + 1] as channel, y, x, round(base, 5) as base, round(recon, 5) as recon from t",
    "reconstruct_rgb": f"with {_CHANNELS}, rc as (select image_id // 3 as image_id, y, x, max(case when image_id % 3 = 0 then recon end) as l, max(case when image_id % 3 = 1 then recon end) as a, max(case when image_id % 3 = 2 then recon end) as b from t group by 1, 2, 3) select image_id, y, x, r, g, b from {twins.rgb('rc')}",
    "layer_sum": f"{BASE} select image_id, y, x, round(q + case when image_id % 2 = 0 then v - q else 0 end, 6) as v from ({_DECODE})",
    "pyramid": f"with {_TWO}, sm as (select image_id, cast(y // 2 as int) as y, cast(x // 2 as int) as x, recon as v from t where y % 2 = 1 and x % 2 = 1), {twins.layer('s', 'sm', EPS, STEPS, EDGE // 2)}, up as (select o.image_id, g.y, g.x, o.recon as up from (select cast(i as int) as y, cast(j as int) as x, greatest(0, i - 1) // 2 as sy, greatest(0, j - 1) // 2 as sx from range(8) a(i), range(8) b(j)) g join s_out o on o.y = sy and o.x = sx), df as (select image_id, y, x, recon - up as v from t join up using (image_id, y, x)), {twins.layer('e', 'df', 0.02, STEPS, EDGE)} select image_id, y, x, round(up + recon, 6) as recon from e_out join up using (image_id, y, x)",
    "subsample_short": f"with {PX} select image_id, cast(y // 2 as int) as y, cast(x // 2 as int) as x, round(v, 6) as v from px where x % 2 = 1 and y % 2 = 1 and x < 7 and y < 7",
    "resized": f"with {PX}, {_resized_sql('px', 'o', (8, 8), (5, 11))} select image_id, y, x, round(v, 6) as v from o",
    "resize_error": f"with {PX}, {_resized_sql('px', 'h', (8, 8), (4, 4))}, {_resized_sql('h', 'o', (4, 4), (8, 8))}, e as (select px.image_id, avg(power(px.v - o.v, 2)) as mse from px join o using (image_id, y, x) group by all) select image_id, round(mse, 9) as mse, round(10 * log10(1 / mse), 5) as psnr from e",
    "first_samples": f"{BASE} select image_id, cast(x + 1 as int) as nth, round(q, 6) as v from ({_DECODE}) where y = 0 and x < 5",
    "palette_errors": f"with {PX}, p as (select image_id, floor(v / {EPS}) as k, avg(v) as m, min(v) as lo, max(v) as hi from px group by all) select image_id, round(avg(greatest(m - lo, hi - m)), 6) as mean_error, round(max(greatest(m - lo, hi - m)), 6) as worst_error, round(64.0::double / count(*), 6) as reduction, cast(greatest(1, ceil(log2(count(*)))) as int) as index_bits from p group by image_id",
    "channel_plane": f"with {RGB}, {_LABS} select image_id, y, x, round(a, 5) as v from lb",
    "lab_mse": f"with {RGB}, {_LABS}, cut as (select image_id, y, x, r // 16 * 16 + 8 as r, g // 16 * 16 + 8 as g, b // 16 * 16 + 8 as b from rgb), lc as {twins.lab('cut')}, e as (select p.image_id, avg(power(p.l - q.l, 2)) as l, avg(power(p.a - q.a, 2)) as a, avg(power(p.b - q.b, 2)) as b from lb p join lc q using (image_id, y, x) group by all) select image_id, channel, round(mse, 5) as mse from (unpivot e on l, a, b into name channel value mse)",
    "noise_uniform": _noise(_U),
    "noise_border": _noise(f"(case when near then 0.85 + {_U} * (1 - 0.85) else {_U} end)", _NEAR).replace("join vp using (image_id, idx))", "join vp using (image_id, idx) join nb using (image_id, y, x))"),
    "noise_normal": f"with {_VOXELS}, z as (select *, l - cl as dl, a - ca as da, b - cb as db from vi join vp using (image_id, idx)), g as (select *, greatest(0.6 * sqrt(dl * dl + da * da + db * db) / 3, 1e-4) as s from z), h as (select *, " + ", ".join(f"0.6 * d{c} + s * {twins.normal(7 + k, ('image_id', 'y', 'x'))} as g{c}" for k, c in enumerate("lab")) + f" from g), w as (select *, case when gl * dl + ga * da + gb * db < 0 then -gl else gl end as ml, case when gl * dl + ga * da + gb * db < 0 then -ga else ga end as ma, case when gl * dl + ga * da + gb * db < 0 then -gb else gb end as mb from h) {_PLACED}",
    "similar_border_blur": _blur_sql(),
    "similar_colours": f"with {_VOXELS} select p.image_id, p.idx as a, q.idx as b from vp p join vp q on p.image_id = q.image_id and p.idx < q.idx where sqrt(power(p.cl - q.cl, 2) + power(p.ca - q.ca, 2) + power(p.cb - q.cb, 2)) < 30",
    "upsample_index_older": _older_sql(),
    "upsample_index_box": _box_sql(),
    "image_scan": f"with {RGB} select image_id, y, x, r, g, b from rgb",
    "format_scan": f"with {RGB} select image_id, ['pnm', 'tga', 'psd', 'hdr'][image_id % 4 + 1] as format, y, x, " + ", ".join(f"case when image_id % 4 = 3 then {twins.hdr(c)} else {c} end as {c}" for c in "rgb") + " from rgb",
    "huffman_codes": _KINDS.replace("with ", "with recursive ", 1) + " select h.image_id, c.key, freq, case when entries = 1 then 0 else list_reduce(list_transform(string_split(c.code, ''), lambda t: cast(t as bigint)), lambda p, t: p * 2 + t) end as code, cast(greatest(1, length(c.code)) as int) as len from hf h join keys k on k.image_id = h.image_id and k.key = c.key",
    "huffman_bits": _KINDS.replace("with ", "with recursive ", 1) + ", t as (select h.image_id, cast(sum(freq * greatest(1, length(c.code))) as bigint) as bits, count(*) as entries from hf h join keys k on k.image_id = h.image_id and k.key = c.key group by h.image_id) select image_id, bits, entries, cast((bits + 7) // 8 as bigint) as bytes from t",
    "size_report": _report_sql(),
    "container_layers": _container_sql(),
    "container_queue": f"with {_BASE} select image_id, queue_idx, shape, direction, width, case when change then first_x else -1 end as x, case when change then first_y else -1 end as y from t_ds",
    "container_reduced": _reduced_sql(),
    "container_dct": f"with {PX}, cs as (select u, i, sqrt((case when u = 0 then 1 else 2 end) / 4.0) * cos(pi() * (2 * i + 1) * u / 8.0) as w from range(4) a(u), range(4) b(i)), co as (select image_id, y // 4 as by_, x // 4 as bx, a.u, b.u as w, sum(v * a.w * b.w) as c from px join cs a on a.i = y % 4 join cs b on b.i = x % 4 group by all), zz as (select r, c, row_number() over (order by r + c, case when (r + c) % 2 = 1 then r else c end) - 1 as k from range(4) a(r), range(4) b(c)) select image_id, by_::int as by, bx::int as bx, k::int as k, cast(greatest(-127, least(127, round(co.c / 0.05))) as int) as q from co join zz on zz.r = u and zz.c = w where k < 5",
    "container_older_queue": f"with {_BASE} select version, image_id, layer, queue_idx, cast(case when version = 1 then shape * 4 + direction else shape * 16 + direction * 4 + width end as int) as code from t_ds, (values (1, 0), (2, 0), (2, 1)) r(version, layer)",
    "container_roundtrip": f"{BASE} select image_id, 193 as layer, y, x, idx, {twins.half('value')} as value from ix join pal using (image_id, idx)",
    "container_first": f"with recursive {_COLOURS} {_COLOUR_PIXELS.format(', '.join(f'least(127.0, greatest(-128.0, trunc(p.{c} + sign(p.{c}) * 0.5)))::double + 0.0 as {c}' for c in 'lab'))}",
    "container_second": f"with recursive {_COLOURS} {_COLOUR_PIXELS.format(', '.join(f'{twins.half(chr(112) + chr(46) + c)} as {c}' for c in 'lab'))}",
    "colour_palette": f"with recursive {_COLOURS} select image_id, idx, round(l, 5) as l, round(a, 5) as a, round(b, 5) as b, round(error, 5) as error from cp",
    "bfs3d": f"with recursive {BIG}, lb as {twins.lab('big')}, vx as (select distinct image_id, cast(floor(l / 5) as int) as kl, cast(floor(a / 5) as int) as ka, cast(floor(b / 5) as int) as kb from lb), {twins.cover('vx', 2)} select image_id, v.kl as kl, v.ka as ka, v.kb as kb, cluster::int as cluster from cv",
    "dct_residual": f"{_DCT_KEPT}, mx as (select image_id, max(abs(c)) as m from rs group by all) select image_id, cast(y as int) as y, cast(x as int) as x, round(c * 2.5 * least(m / 10, 1.0), 6) + 0.0 as v from rs join mx using (image_id)",
    "deblock": f"with {PX}, {twins.deblocked('px', 4, 2, 0.5)}",
    "region_blur": f"{BASE}, rg as (select image_id, y, x, idx, floor((v + 0.6) * 200) as v from ix), {twins.region_blur('rg')} select image_id, y, x, v from rb6",
}
