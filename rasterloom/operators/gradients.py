"""Boundary gradients between clusters: segments, their descriptors, change points, and blending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import eased, width_pixels
from .stencil import along_columns, along_rows, tiled


def edges(indexed: DataFrame, width: int, diagonals: bool = True) -> DataFrame:
    """Pixels whose right or lower neighbour has another cluster.

    image_id, edge_seq (raster order, right before down), x, y, ca, cb, lo, hi and the samples taken there: the
    two pixels, then (with diagonals) those of the neighbour's row at x - 1 to x + 1 that have its cluster.
    """
    t = tiled(indexed.select("image_id", "y", "x", "idx", "v"), 1)
    t = t.withColumn("me", F.struct("idx", "v")).withColumn("down", F.lead("me").over(along_columns()))
    near = {"left": F.lag("me"), "right": F.lead("me"), "dl": F.lag("down"), "dr": F.lead("down")}
    t = t.select("*", *(value.over(along_rows()).alias(name) for name, value in near.items())).where("own")

    def side(nth: int, other: str, before: str, own: str, after: str):
        around = F.filter(F.array(before, own, after), lambda s: s["idx"] == F.col(other)["idx"])
        samples = F.array(F.col("v"), F.col(other)["v"])
        if diagonals:
            samples = F.concat(samples, F.transform(around, lambda s: s["v"]))
        return F.struct(F.lit(nth).alias("nth"), F.col(other)["idx"].alias("cb"), samples.alias("samples"))

    t = t.select("image_id", "y", "x", F.col("idx").alias("ca"), F.explode(F.array(side(0, "right", "left", "me", "right"), side(1, "down", "dl", "down", "dr"))).alias("s"))
    t = t.where("s.cb is not null and s.cb <> ca")
    seq = 2 * (F.col("y").cast("long") * width + F.col("x")) + F.col("s.nth")
    return t.select("image_id", seq.alias("edge_seq"), "x", "y", "ca", F.col("s.cb").alias("cb"), F.least("ca", "s.cb").alias("lo"), F.greatest("ca", "s.cb").alias("hi"), F.col("s.samples").alias("samples"))


def first_seen(edges: DataFrame) -> DataFrame:
    """Pairs of clusters numbered by first encounter: image_id, lo, hi, first_seq, pair_no."""
    t = edges.groupBy("image_id", "lo", "hi").agg(F.min("edge_seq").alias("first_seq"))
    return t.withColumn("pair_no", (F.row_number().over(W.partitionBy("image_id").orderBy("first_seq")) - 1).cast("long"))


def _with_shape(t: DataFrame) -> DataFrame:
    """t (samples, low, high) with the shape code whose curve has the least L1 error over the samples in order.

    The three errors are one fold over the samples, made once, and compared as columns; those that agree to nine
    decimals tie, and the lower code wins.
    """
    n = "size(samples)"
    at = f"(cast(i as double)/greatest({n} - 1, 1))"
    norm = "least(1.0D, greatest(0.0D, (s - low)/(high - low)))"
    apart = ", ".join(f"abs({norm} - {eased(at, str(k))}) as e{k}" for k in (1, 2, 3))
    start = "named_struct('e1', 0.0D, 'e2', 0.0D, 'e3', 0.0D)"
    t = t.withColumn("_apart", F.expr(f"transform(samples, (s, i) -> struct({apart}))"))
    last = "e -> named_struct('e1', round(e.e1, 9), 'e2', round(e.e2, 9), 'e3', round(e.e3, 9))"
    t = t.withColumn("_e", F.expr(f"aggregate(_apart, {start}, (t, e) -> named_struct('e1', t.e1 + e.e1, 'e2', t.e2 + e.e2, 'e3', t.e3 + e.e3), {last})"))
    shape = f"""case when {n} = 0 then 1 when high - low < 1e-4 then 0 when least(_e.e1, _e.e2, _e.e3) > round(0.3D*{n}, 9) then 0
        when _e.e1 <= least(_e.e2, _e.e3) then 1 when _e.e2 <= _e.e3 then 2 else 3 end"""
    return t.withColumn("shape", F.expr(shape)).drop("_apart", "_e")


def segments(edges: DataFrame, indexed: DataFrame, size: int, bump: bool = True) -> DataFrame:
    """Chunks of `size` edges of each pair's boundary with their descriptors and the order they are emitted in.

    With bump, widths are one code larger.

    image_id, lo, hi, seg, n, first_x, first_y, shape, direction, width, flush (a struct that sorts in order).
    Full chunks are emitted at their last edge, the rest at the end by pair.
    """
    rn = F.row_number().over(W.partitionBy("image_id", "lo", "hi").orderBy("edge_seq")) - 1
    t = edges.withColumn("seg", F.floor(rn / size).cast("int"))
    at = lambda c, f: f(F.col(c), F.col("edge_seq"))
    t = t.groupBy("image_id", "lo", "hi", "seg").agg(
        F.count("*").alias("n"), F.max("edge_seq").alias("last_seq"), F.max("x").alias("max_x"), F.min("x").alias("min_x"), F.max("y").alias("max_y"), F.min("y").alias("min_y"),
        at("x", F.min_by).alias("first_x"), at("y", F.min_by).alias("first_y"), at("x", F.max_by).alias("last_x"), at("y", F.max_by).alias("last_y"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("edge_seq", "samples"))), lambda s: s["samples"])).alias("samples"),
    )
    mean = indexed.groupBy("image_id", "idx").agg(F.avg("v").alias("m"))
    for name in ("lo", "hi"):
        t = t.join(mean.select("image_id", F.col("idx").alias(name), F.col("m").alias(f"m{name}")), ["image_id", name])
    t = t.withColumn("low", F.least("mlo", "mhi")).withColumn("high", F.greatest("mlo", "mhi"))
    span_x, span_y = "(max_x - min_x)", "(max_y - min_y)"
    direction = f"case when n < 2 then 0 when {span_x} > 2*{span_y} then 0 when {span_y} > 2*{span_x} then 1 when (last_x - first_x)*(last_y - first_y) >= 0 then 2 else 3 end"
    between = "size(filter(samples, s -> s > low + 0.1D and s < high - 0.1D))"
    width = f"case when {between} <= 1 then 0 when {between} <= 3 then 1 when {between} <= 6 then 2 else 3 end"
    full = F.col("n") >= size
    flush = F.struct(F.when(full, 0).otherwise(1).alias("late"), F.when(full, F.col("last_seq")).otherwise(0).alias("seq"), "lo", "hi")
    t = _with_shape(t).select("image_id", "lo", "hi", "seg", "n", "first_x", "first_y", "shape", F.expr(direction).alias("direction"), F.expr(width).alias("width"), flush.alias("flush"))
    return t.withColumn("width", F.least(F.lit(3), F.col("width") + 1)) if bump else t


def _emitted_by_lag(segments: DataFrame, threshold: float) -> DataFrame:
    fields = ("shape", "direction", "width") if threshold <= 0.3 else ("shape", "direction")
    pair = W.partitionBy("image_id", "lo", "hi").orderBy("seg")
    differs = F.lit(False)
    for f in fields:
        differs = differs | (F.col(f) != F.lag(f).over(pair))
    return segments.withColumn("emits", (F.col("seg") == 0) | F.coalesce(differs, F.lit(False))).where("emits")


def _emitted_by_fold(segments: DataFrame, threshold: float, directions: bool) -> DataFrame:
    """One array a pair and image, folded in order; distances are counted in tenths, which are whole numbers."""

    def step(out, s):
        last = F.element_at(out, -1)
        tenths = sum((F.when(last[f] != s[f], n).otherwise(0) for f, n in (("shape", 10), ("direction", 5), ("width", 3))), F.lit(0))
        emits = tenths >= F.lit(threshold * 10 - 1e-6)
        if directions:
            emits = emits | (last["direction"] != s["direction"])
        return F.when(emits, F.concat(out, F.array(s))).otherwise(out)

    rest = [c for c in segments.columns if c not in ("image_id", "lo", "hi")]
    t = segments.groupBy("image_id", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("seg", *(c for c in rest if c != "seg")))).alias("all"))
    t = t.select("image_id", "lo", "hi", F.explode(F.aggregate("all", F.slice("all", 1, 1), step)).alias("s"))
    return t.select("image_id", "lo", "hi", "s.*")


def descriptors(segments: DataFrame, threshold: float, directions: bool = True) -> DataFrame:
    """Emitted descriptors: image_id, queue_idx, lo, hi, first_x, first_y, shape, direction, width, change.

    A segment emits if it is its pair's first, or differs from the last emitted descriptor by the threshold (shape
    counts 1.0, direction 0.5, width 0.3) or, with directions, in direction. Up to 1.0 that is then a change against the
    previous segment (of any field up to 0.3, else of shape or direction), so a lag suffices; else a pair's segments
    are folded.
    """
    t = _emitted_by_fold(segments, threshold, directions) if threshold > 1.0 or not directions else _emitted_by_lag(segments, threshold)
    queue = (F.row_number().over(W.partitionBy("image_id").orderBy("flush")) - 1).cast("long")
    return t.select("image_id", queue.alias("queue_idx"), "lo", "hi", "first_x", "first_y", "shape", "direction", "width", (F.col("seg") > 0).alias("change"))


def _sides(decoded: DataFrame) -> DataFrame:
    """Pixels with each of their four neighbours of another cluster: image_id, y, x, ca, pa, nb, cb, pb, behind, dx, dy, lo, hi.

    nb numbers the neighbours +x, -x, +y, -y; behind is the cluster on the other side of the pixel.
    """
    t = tiled(decoded.select("image_id", "y", "x", "idx", "recon").withColumn("me", F.struct("idx", "recon")), 1)
    around = (("e", F.lead, along_rows()), ("w", F.lag, along_rows()), ("s", F.lead, along_columns()), ("n", F.lag, along_columns()))
    t = t.select("*", *(f("me").over(window).alias(name) for name, f, window in around)).where("own")
    sides = [("e", "w", 1, 0), ("w", "e", -1, 0), ("s", "n", 0, 1), ("n", "s", 0, -1)]
    t = t.select("image_id", "y", "x", F.col("idx").alias("ca"), F.col("recon").alias("pa"), F.explode(F.array(*(F.struct(F.lit(k).alias("nb"), F.col(a)["idx"].alias("cb"), F.col(a)["recon"].alias("pb"), F.col(o)["idx"].alias("behind"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (a, o, dx, dy) in enumerate(sides)))).alias("s"))
    return t.select("image_id", "y", "x", "ca", "pa", "s.*").where("cb is not null and cb <> ca").withColumn("lo", F.least("ca", "cb")).withColumn("hi", F.greatest("ca", "cb"))


def _described(sides: DataFrame, edges: DataFrame, descriptors: DataFrame) -> DataFrame:
    """sides with the descriptor that holds there: that of a change at the pixel, else of the pair's number, else the first.

    Numbers end with the queue: a pair first seen on the second edge of the pixel whose first edge took the last one
    has no descriptor and drops out; later pairs take the first.
    """
    size = descriptors.groupBy("image_id").agg(F.count("*").alias("queue_size"))
    seen = first_seen(edges).withColumn("before", F.lag("first_seq").over(W.partitionBy("image_id").orderBy("first_seq")))
    numbered = (F.col("pair_no") < F.col("queue_size")) | ((F.col("pair_no") == F.col("queue_size")) & (F.col("first_seq") % 2 == 1) & (F.col("before") == F.col("first_seq") - 1))
    pairs = seen.join(size, "image_id").where(numbered).select("image_id", "lo", "hi", "pair_no")
    changes = descriptors.where("change").groupBy("image_id", F.col("first_x").alias("x"), F.col("first_y").alias("y")).agg(F.max("queue_idx").alias("change_idx"))
    t = sides.join(changes, ["image_id", "x", "y"], "left").join(pairs, ["image_id", "lo", "hi"], "left")
    return t.withColumn("queue_idx", F.coalesce("change_idx", "pair_no", F.lit(0).cast("long"))).join(descriptors.select("image_id", "queue_idx", "shape", "direction", "width"), ["image_id", "queue_idx"])


def _written(decoded: DataFrame, writes: DataFrame) -> DataFrame:
    """Pixels with the last of the writes (image_id, x, y, value, order) to each."""
    wrote = writes.groupBy("image_id", "x", "y").agg(F.max_by("value", "order").alias("wrote"))
    return decoded.select("image_id", "y", "x", "recon").join(wrote, ["image_id", "x", "y"], "left").select("image_id", "y", "x", F.coalesce("wrote", "recon").alias("recon"))


def blended(decoded: DataFrame, edges: DataFrame, descriptors: DataFrame, width: int, linear: bool = False) -> DataFrame:
    """Pixels (image_id, y, x, idx, recon) after blending across boundaries: image_id, y, x, recon.

    Each pixel and each of its four neighbours of another cluster writes at most three pixels: behind it, itself and
    the neighbour. The last write of a pixel stands (raster order, then +x, -x, +y, -y, then outwards).
    """
    t = _described(_sides(decoded), edges, descriptors)
    t = t.withColumn("h", F.expr(width_pixels("width"))).withColumn("o", F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1)))))
    t = t.where("o >= 0 or behind in (ca, cb)")
    step = "(case o when -1 then -ceil(h/2.0D) when 0 then ceil(h/2.0D) - 1 else h end)"
    t = t.withColumn("t", F.expr(f"({step} + h)/(2.0D*h + 1)"))
    value = F.expr(f"pa + {eased('t', '1' if linear else 'shape')}*(pb - pa)")
    order = ((F.col("y").cast("long") * width + F.col("x")) * 4 + F.col("nb")) * 3 + F.col("o") + 1
    return _written(decoded, t.select("image_id", (F.col("x") + F.col("o") * F.col("dx")).alias("x"), (F.col("y") + F.col("o") * F.col("dy")).alias("y"), value.alias("value"), order.alias("order")))


def blended_along(decoded: DataFrame, edges: DataFrame, descriptors: DataFrame, width: int) -> DataFrame:
    """As blended, but each side writes along its descriptor's direction, from half a width behind the pixel to half a width beyond.

    Directions are x, y, and the diagonals with y growing or falling. A width code that is none is 3 pixels. Only
    pixels of the two clusters are written; the last write stands.
    """
    t = _described(_sides(decoded), edges, descriptors).withColumn("h", F.expr(width_pixels("width", 3)))
    t = t.withColumn("d", F.explode(F.expr("sequence(-h, h)"))).withColumn("t", F.expr("(d + h)/(2.0D*h + 1)"))
    to_x, to_y = F.expr("x + if(direction = 1, 0, d)"), F.expr("y + case direction when 0 then 0 when 3 then -d else d end")
    order = ((F.col("y").cast("long") * width + F.col("x")) * 4 + F.col("nb")) * 32 + F.col("d") + 16
    t = t.select("image_id", to_x.alias("x"), to_y.alias("y"), "ca", "cb", F.expr(f"pa + {eased('t', 'shape')}*(pb - pa)").alias("value"), order.alias("order"))
    t = t.join(decoded.select("image_id", "y", "x", "idx"), ["image_id", "y", "x"]).where("idx in (ca, cb)")
    return _written(decoded, t.select("image_id", "x", "y", "value", "order"))
