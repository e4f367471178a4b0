"""Stencils, resampling, block transforms and quality metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows and columns of a tile.
TILE = 256


def tiled(planes: DataFrame, reach: int) -> DataFrame:
    """planes dealt to tiles ty, tx by one shuffle, with `own`: pixels also go to each tile that is `reach` or less away, there not as its own.

    Inside a tile, windows along rows and along columns then need no shuffle, and its own pixels see everything up
    to `reach` pixels off as in the whole image.
    """
    at = lambda c: F.array_distinct(F.array(*(F.expr(f"({c} + {d}) div {TILE}") for d in (-reach, 0, reach))))
    t = planes.withColumn("ty", F.explode(at("y"))).withColumn("tx", F.explode(at("x")))
    return t.withColumn("own", F.expr(f"ty = y div {TILE} and tx = x div {TILE}")).repartition("image_id", "ty", "tx")


def along_rows():
    """The window of a tile's row."""
    return W.partitionBy("image_id", "ty", "tx", "y").orderBy("x")


def along_columns():
    """The window of a tile's column."""
    return W.partitionBy("image_id", "ty", "tx", "x").orderBy("y")


def neighbourhood(planes: DataFrame, column: str | dict[str, str], radius: int, clamp: bool = True) -> DataFrame:
    """planes with `nb`: the (2r + 1)**2 values of a column around each pixel, row by row; or several such, by name.

    Values beyond the border are those of the nearest pixel (clamp) or null. One shuffle to tiles, then windows by
    row and by column; no pixel is copied for each of its neighbours.
    """
    row, tall = along_rows(), along_columns()

    def shifted(value: str, d: int, window) -> Column:
        far = [(F.lag if d < 0 else F.lead)(value, k).over(window) for k in range(abs(d), 0, -1)]
        return F.coalesce(*far, F.col(value)) if clamp else (far[0] if far else F.col(value))

    reach, names = range(-radius, radius + 1), column if isinstance(column, dict) else {"nb": column}
    t = tiled(planes, radius)
    t = t.select("*", *(F.array(*(shifted(c, d, row) for d in reach)).alias(f"_{n}") for n, c in names.items()))
    none = F.array_repeat(F.lit(None).cast("double"), 2 * radius + 1)
    t = t.select("*", *(F.flatten(F.array(*(F.coalesce(shifted(f"_{n}", d, tall), none) for d in reach))).alias(n) for n in names))
    return t.where("own").drop("ty", "tx", "own", *(f"_{n}" for n in names))


def gauss3(planes: DataFrame) -> DataFrame:
    """3 x 3 binomial filter (1 2 1), borders clamped: image_id, y, x, g."""
    weights = [a * b / 16 for a in (1, 2, 1) for b in (1, 2, 1)]
    total = sum((F.col("nb")[k] * w for k, w in enumerate(weights)), F.lit(0.0))
    return neighbourhood(planes, "v", 1).select("image_id", "y", "x", total.alias("g"))


def median3(planes: DataFrame) -> DataFrame:
    """3 x 3 median, borders clamped: image_id, y, x, m."""
    return neighbourhood(planes, "v", 1).select("image_id", "y", "x", F.array_sort("nb")[4].alias("m"))


def bilateral(planes: DataFrame, radius: int = 2, space: float = 5.0, tone: float = 5.0) -> DataFrame:
    """Bilateral filter, borders clamped, truncated to whole values (sums a billionth short count as whole): image_id, y, x, f."""
    top, weight, side = F.lit(0.0), F.lit(0.0), 2 * radius + 1
    for k in range(side * side):
        d2 = (k // side - radius) ** 2 + (k % side - radius) ** 2
        w = F.exp(F.lit(-d2 / (2 * space * space)) - F.pow(F.col("nb")[k] - F.col("v"), F.lit(2.0)) / (2 * tone * tone))
        top, weight = top + w * F.col("nb")[k], weight + w
    return neighbourhood(planes, "v", radius).select("image_id", "y", "x", F.floor(top / weight + 1e-9).cast("int").alias("f"))


def soft_lowpass(planes: DataFrame, strength: float = 0.2, radius: int = 1) -> DataFrame:
    """p (1 - s) + s times a Gaussian (sigma 0.75 r) over the pixels that exist: image_id, y, x, s."""
    top, weight, side, sigma = F.lit(0.0), F.lit(0.0), 2 * radius + 1, 0.75 * radius
    for k in range(side * side):
        w = math.exp(-((k // side - radius) ** 2 + (k % side - radius) ** 2) / (2 * sigma * sigma))
        top = top + F.coalesce(F.col("nb")[k] * w, F.lit(0.0))
        weight = weight + F.when(F.col("nb")[k].isNotNull(), w).otherwise(0.0)
    soft = F.col("v") * (1 - strength) + top / weight * strength
    return neighbourhood(planes, "v", radius, clamp=False).select("image_id", "y", "x", soft.alias("s"))


def region_blur(indexed: DataFrame, radius: int = 1, passes: int = 3) -> DataFrame:
    """Box blur inside clusters: `passes` times along rows, then columns, over members of the pixel's own cluster, truncated each time."""
    t = tiled(indexed.select("image_id", "y", "x", "idx", "v"), passes * radius)
    for _ in range(passes):
        for window in (along_rows(), along_columns()):
            top, count = F.col("v"), F.lit(1)
            for d in [k for k in range(-radius, radius + 1) if k]:
                same = F.lead("idx", d).over(window) == F.col("idx") if d > 0 else F.lag("idx", -d).over(window) == F.col("idx")
                value = F.lead("v", d).over(window) if d > 0 else F.lag("v", -d).over(window)
                top, count = top + F.when(same, value).otherwise(0.0), count + F.when(same, 1).otherwise(0)
            t = t.select("image_id", "ty", "tx", "own", "y", "x", "idx", F.floor(top / count).cast("double").alias("v"))
    return t.where("own").drop("ty", "tx", "own")


def near_boundary(indexed: DataFrame, distance: int) -> DataFrame:
    """Pixels with a different cluster within that L1 distance: image_id, y, x."""
    t = neighbourhood(indexed.withColumn("idx", F.col("idx").cast("double")), "idx", distance, clamp=False)
    side = 2 * distance + 1
    test = F.lit(False)
    for k in range(side * side):
        if 0 < abs(k // side - distance) + abs(k % side - distance) <= distance:
            test = test | F.coalesce(F.col("nb")[k] != F.col("idx"), F.lit(False))
    return t.where(test).select("image_id", "y", "x")


def similar_border_blur(planes: DataFrame, colour: tuple[str, ...], radius: int = 3, threshold: float = 10.0) -> DataFrame:
    """Gaussian blur (sigma radius / 2) near borders of similar clusters: image_id, y, x, v.

    planes: image_id, y, x, idx, v (0 to 255) and the cluster's colour. A pixel is blurred if, at most `radius` rows and
    columns away, some pixel has a neighbour of another cluster whose colour is nearer than the threshold. Pixels
    beyond the image have no weight; results are truncated. Clusters' colours are compared where they meet, so no
    pair of palette entries is.
    """
    side = 2 * radius + 1
    t, near = tiled(planes.withColumn("_me", F.struct("idx", *colour)), 1), F.lit(False)
    for f, window in ((F.lead, along_rows()), (F.lag, along_rows()), (F.lead, along_columns()), (F.lag, along_columns())):
        other = f("_me").over(window)
        apart = F.sqrt(sum(((other[c] - F.col(c)) * (other[c] - F.col(c)) for c in colour), F.lit(0.0)))
        near = near | F.coalesce((other["idx"] != F.col("idx")) & (apart < threshold), F.lit(False))
    t = t.withColumn("_near", F.when(near, 1.0).otherwise(0.0)).where("own").select("image_id", "y", "x", "v", "_near")
    t = neighbourhood(t, {"nb": "v", "_around": "_near"}, radius, clamp=False)
    weight, top, total = [], F.lit(0.0), F.lit(0.0)
    for k in range(side * side):
        weight.append(math.exp(-((k // side - radius) ** 2 + (k % side - radius) ** 2) / (2 * (radius / 2) ** 2)))
        top = top + F.coalesce(F.col("nb")[k] * weight[k], F.lit(0.0))
        total = total + F.when(F.col("nb")[k].isNotNull(), weight[k]).otherwise(0.0)
    soft = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), top / total + 1e-9)))
    return t.select("image_id", "y", "x", F.when(F.exists("_around", lambda n: n > 0), soft.cast("double")).otherwise(F.col("v")).alias("v"))


def subsample(values: DataFrame, column: str, odd: bool = True, size: tuple[int, int] | None = None) -> DataFrame:
    """Every second row and column: image_id, y, x and the column, at half the coordinates.

    With size (width, height) of the whole, samples end at half of one less, so an even side's last one is left out.
    """
    rest = 1 if odd else 0
    if size:
        values = values.where((F.col("x") < (size[0] - 1) // 2 * 2 + rest) & (F.col("y") < (size[1] - 1) // 2 * 2 + rest))
    t = values.where((F.col("x") % 2 == rest) & (F.col("y") % 2 == rest))
    return t.select("image_id", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x"), column)


def upsample_nearest(small: DataFrame, column: str, width: int, height: int) -> DataFrame:
    """Each pixel of a width x height grid takes the sample at (coordinate - 1) / 2, clamped; a join on samples, exploded to their pixels."""
    limits = small.groupBy("image_id").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    grid = limits.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    source = lambda c, m: F.least(F.col(m), F.greatest(F.lit(0), F.expr(f"cast(floor(({c} - 1) / 2) as int)")))
    grid = grid.select("image_id", "y", "x", source("y", "my").alias("sy"), source("x", "mx").alias("sx"))
    own = small.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), column)
    return grid.join(own, ["image_id", "sy", "sx"]).select("image_id", "y", "x", column)


def resized(planes: DataFrame, sizes: tuple[int, int], width: int, height: int) -> DataFrame:
    """Planes of sizes (width, height) at another width and height, by bilinear weights of pixel centres: image_id, y, x, v.

    A target pixel has two source places an axis (one at the borders); pixels join the targets that they have a share in.
    """

    def places(n: int, out: int) -> list[tuple[int, int, float]]:
        found = []
        for k in range(out):
            at = min(max((k + 0.5) * n / out - 0.5, 0.0), n - 1.0)
            low = int(at)
            found += [(k, low, 1 - (at - low))] + ([(k, low + 1, at - low)] if at > low else [])
        return found

    def taps(axis: str, n: int, out: int) -> Column:
        listed = F.array(*(F.struct(F.lit(k).alias("to"), F.lit(at).alias("at"), F.lit(w).alias("w")) for k, at, w in places(n, out)))
        return F.filter(listed, lambda t: t["at"] == F.col(axis))

    t = planes
    for axis, n, out in (("x", sizes[0], width), ("y", sizes[1], height)):
        other = "y" if axis == "x" else "x"
        t = t.select("image_id", other, "v", F.explode(taps(axis, n, out)).alias("t"))
        t = t.groupBy("image_id", other, F.col("t.to").alias(axis)).agg(F.sum(F.col("v") * F.col("t.w")).alias("v"))
    return t.select("image_id", "y", "x", "v")


def nearest_to_midpoint(pairs: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, a, b, idx): the palette entry nearest to the middle of entries a and b; ties take the least idx.

    Distances that agree to nine decimals tie: a and b themselves always do, whatever the order of their sums.

    Middles and entries are sorted together, so a middle sees the entry below and the one above: work grows with
    their sum, not their product.
    """
    value = lambda name: palette.select("image_id", F.col("idx").alias(name), F.col("value").alias(f"v{name}"))
    t = pairs.select("image_id", "a", "b").distinct().join(value("a"), ["image_id", "a"]).join(value("b"), ["image_id", "b"])
    middle = t.select("image_id", "a", "b", ((F.col("va") + F.col("vb")) / 2).alias("at"), F.lit(None).cast("struct<value:double,idx:int>").alias("e"))
    entry = palette.select("image_id", F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.col("value").cast("double").alias("at"), F.struct(F.col("value").cast("double").alias("value"), F.col("idx").cast("int").alias("idx")).alias("e"))
    # the least idx of equal values is the last of those below and the first of those above
    at = W.partitionBy("image_id").orderBy
    below = F.last("e", True).over(at(F.col("at"), F.col("e").isNull(), F.desc("e.idx")).rowsBetween(W.unboundedPreceding, 0))
    above = F.last("e", True).over(at(F.desc("at"), F.col("e").isNull(), F.desc("e.idx")).rowsBetween(W.unboundedPreceding, 0))
    t = middle.unionByName(entry).select("*", below.alias("lo"), above.alias("hi")).where("e is null")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.round(F.abs(F.col(f"{c}.value") - F.col("at")), 9).alias("d"), F.col(f"{c}.idx").alias("idx")))
    return t.select("image_id", "a", "b", F.least(near("lo"), near("hi"))["idx"].alias("idx"))


def similar_pairs(palette: DataFrame, threshold: float, colour: tuple[str, ...] = ("value",)) -> DataFrame:
    """Pairs of one image's palette entries nearer than the threshold: image_id, a, b.

    Entries meet in buckets of the threshold along the first axis: those of one bucket and of neighbouring ones.
    """
    k = F.floor(F.col(colour[0]) / threshold)
    a = palette.select("image_id", F.col("idx").alias("a"), F.explode(F.array(k - 1, k, k + 1)).alias("k"), *(F.col(c).alias(f"a_{c}") for c in colour))
    b = palette.select("image_id", F.col("idx").alias("b"), k.alias("k"), *(F.col(c).alias(f"b_{c}") for c in colour))
    apart = F.sqrt(sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), F.lit(2.0)) for c in colour), F.lit(0.0)))
    return a.join(b, ["image_id", "k"]).where((F.col("a") < F.col("b")) & (apart < threshold)).select("image_id", "a", "b")


def zigzag(n: int) -> list[tuple[int, int]]:
    """Cells (row, column) of an n x n block in zig-zag order."""
    return sorted(((r, c) for r in range(n) for c in range(n)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))


def dct_basis(n: int) -> list[list[float]]:
    """Row u: the orthonormal cosine of frequency u."""
    return [[math.sqrt((1 if u == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * u / (2 * n)) for i in range(n)] for u in range(n)]


def _transformed(t: DataFrame, n: int, inverse: bool, cells: list[int] | None = None) -> DataFrame:
    """Each block (image_id, by, bx, block) times the 2-D basis: image_id, by, bx, p, c; one row a cell (of those asked for), no join."""
    basis = dct_basis(n)
    if inverse:
        basis = [list(c) for c in zip(*basis, strict=True)]
    rows = F.array(*(F.struct(F.lit(p).alias("p"), F.array(*(F.lit(a * b) for a in basis[p // n] for b in basis[p % n])).alias("w")) for p in (range(n * n) if cells is None else cells)))
    t = t.select("image_id", "by", "bx", "block", F.explode(rows).alias("r")).select("image_id", "by", "bx", "block", "r.p", "r.w")
    return t.select("image_id", "by", "bx", "p", F.aggregate(F.zip_with("w", "block", lambda w, v: w * v), F.lit(0.0), lambda s, v: s + v).alias("c"))


def _array_of(entries: Column, n: int) -> Column:
    """An array of n * n values from collected (cell, value) entries, 0 where there is none."""
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda p: F.coalesce(F.try_element_at(entries, p), F.lit(0.0)))


def blocks(planes: DataFrame, n: int) -> DataFrame:
    """n x n blocks, zero where the image ends: image_id, by, bx, block (row by row)."""
    t = planes.groupBy("image_id", F.expr(f"cast(y div {n} as int)").alias("by"), F.expr(f"cast(x div {n} as int)").alias("bx")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"y % {n} * {n} + x % {n}"), "v"))).alias("at"))
    return t.select("image_id", "by", "bx", _array_of(F.col("at"), n).alias("block"))


def dct(planes: DataFrame, n: int, keep: int | None = None) -> DataFrame:
    """Block coefficients, all or the first `keep` in zig-zag order: image_id, by, bx, p (cell, row by row), c."""
    return _transformed(blocks(planes, n), n, False, None if keep is None else [r * n + c for r, c in zigzag(n)[:keep]])


def _pixels(t: DataFrame, n: int, value: Column) -> DataFrame:
    return t.select("image_id", F.expr(f"cast(by * {n} + p div {n} as int)").alias("y"), F.expr(f"cast(bx * {n} + p % {n} as int)").alias("x"), value.alias("v"))


def _inverse(coefs: DataFrame, n: int) -> DataFrame:
    t = coefs.groupBy("image_id", "by", "bx").agg(F.map_from_entries(F.collect_list(F.struct("p", "c"))).alias("at"))
    return _transformed(t.select("image_id", "by", "bx", _array_of(F.col("at"), n).alias("block")), n, True)


def idct(coefs: DataFrame, n: int) -> DataFrame:
    """Coefficients back as pixels: image_id, y, x, v."""
    return _pixels(_inverse(coefs, n), n, F.col("c"))


def keep_coefficients(coefs: DataFrame, n: int, keep: int, step: float) -> DataFrame:
    """The first `keep` zig-zag coefficients, quantised and clamped to +-127: image_id, by, bx, k, q."""
    place = F.create_map(*(F.lit(x) for k, (r, c) in enumerate(zigzag(n)[:keep]) for x in (r * n + c, k)))
    t = coefs.withColumn("k", F.try_element_at(place, F.col("p"))).where("k is not null")
    return t.select("image_id", "by", "bx", "k", F.greatest(F.lit(-127), F.least(F.lit(127), F.round(F.col("c") / step).cast("int"))).alias("q"))


def restored_residual(kept: DataFrame, n: int, step: float, strength: float) -> DataFrame:
    """Residual pixels of kept coefficients; a block's strength is strength * min(its largest value / 10, 1)."""
    cells = F.array(*(F.lit(r * n + c) for r, c in zigzag(n)))
    t = _inverse(kept.select("image_id", "by", "bx", F.element_at(cells, F.col("k") + 1).alias("p"), (F.col("q") * F.lit(float(step))).alias("c")), n)
    largest = F.max(F.abs("c")).over(W.partitionBy("image_id", "by", "bx"))
    return _pixels(t.withColumn("s", strength * F.least(largest / 10, F.lit(1.0))), n, F.col("c") * F.col("s"))


def deblocked(planes: DataFrame, n: int, reach: int, limit: float) -> DataFrame:
    """Pixels within `reach` of a block's edge, blended with the centre pixel of the block beyond it: image_id, y, x, v.

    A neighbour's weight is smoothstep((reach - distance) / reach) * (1 - jump / limit), if the jump is below the
    limit; the result is (v + sum w c) / (1 + sum w). Centres are one row a block and join by block.
    """
    t = planes.withColumn("by", F.expr(f"cast(y div {n} as int)")).withColumn("bx", F.expr(f"cast(x div {n} as int)"))
    centre = t.where((F.col("y") % n == n // 2) & (F.col("x") % n == n // 2)).select("image_id", "by", "bx", F.col("v").alias("c"))
    inside = lambda c: F.col(c) % n
    sides = [(0, -1, inside("x")), (0, 1, n - 1 - inside("x")), (-1, 0, inside("y")), (1, 0, n - 1 - inside("y"))]
    near = F.filter(F.array(*(F.struct((F.col("by") + dy).alias("by"), (F.col("bx") + dx).alias("bx"), d.alias("d")) for dy, dx, d in sides)), lambda s: s["d"] < reach)
    e = t.select("image_id", "y", "x", "v", F.explode(near).alias("s")).select("image_id", "y", "x", "v", "s.*").join(centre, ["image_id", "by", "bx"])
    e = e.withColumn("u", (reach - F.col("d")) / reach).withColumn("jump", F.abs(F.col("c") - F.col("v"))).where(F.col("jump") < limit)
    e = e.withColumn("w", F.col("u") * F.col("u") * (3 - 2 * F.col("u")) * (1 - F.col("jump") / limit))
    e = e.groupBy("image_id", "y", "x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("c")).alias("wc"))
    return planes.join(e, ["image_id", "y", "x"], "left").select("image_id", "y", "x", ((F.col("v") + F.coalesce("wc", F.lit(0.0))) / (1 + F.coalesce("w", F.lit(0.0)))).alias("v"))


def aligned(original: DataFrame, other: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, v) of two relations side by side: image_id, y, x, p, q; images of different shapes raise when they are read."""
    t = original.select("image_id", "y", "x", F.col("v").alias("p")).join(other.select("image_id", "y", "x", F.col("v").alias("q")), ["image_id", "y", "x"], "full")
    whole = F.assert_true(F.col("p").isNotNull() & F.col("q").isNotNull(), F.lit("the images' shapes differ"))
    return t.where(whole.isNull())


def first_samples(planes: DataFrame, n: int) -> DataFrame:
    """The first n pixels of each image in raster order, numbered: image_id, nth, v."""
    nth = F.row_number().over(W.partitionBy("image_id").orderBy("y", "x"))
    return planes.select("image_id", nth.alias("nth"), "v").where(F.col("nth") <= n)


def channel_mse(pairs: DataFrame) -> DataFrame:
    """Mean squared error of each channel of pairs (image_id, channel, p, q): image_id, channel, mse."""
    return pairs.groupBy("image_id", "channel").agg(F.avg((F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))).alias("mse"))


def mse_psnr(pairs: DataFrame, peak: float = 255.0) -> DataFrame:
    """Per image of pairs (image_id, p, q): mse and psnr (null if mse is 0)."""
    t = pairs.groupBy("image_id").agg(F.avg(F.pow(F.col("p") - F.col("q"), F.lit(2.0))).alias("mse"))
    return t.withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(peak * peak / F.col("mse"))))


def ssim(pairs: DataFrame, size: int = 7, peak: float = 1.0) -> DataFrame:
    """Mean structural similarity per image of pairs (image_id, y, x, p, q) over whole uniform windows, sample covariances."""
    r, n = size // 2, size * size
    t = neighbourhood(pairs, {"np": "p", "nb": "q"}, r, clamp=False).where(F.expr("forall(nb, v -> v is not null)"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    product = lambda a, b: add(F.zip_with(a, b, lambda x, y: x * y))
    t = t.select("image_id", (add("np") / n).alias("up"), (add("nb") / n).alias("uq"), product("np", "np").alias("pp"), product("nb", "nb").alias("qq"), product("np", "nb").alias("pq"))
    cov = lambda s, a, b: (F.col(s) - n * F.col(a) * F.col(b)) / (n - 1)
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    s = (2 * F.col("up") * F.col("uq") + c1) * (2 * cov("pq", "up", "uq") + c2) / ((F.col("up") ** 2 + F.col("uq") ** 2 + c1) * (cov("pp", "up", "up") + cov("qq", "uq", "uq") + c2))
    return t.groupBy("image_id").agg(F.avg(s).alias("ssim"))


def difference_map(pairs: DataFrame) -> DataFrame:
    """|p - q| stretched to 0..255 over each image: image_id, y, x, d."""
    t = pairs.withColumn("a", F.abs(F.col("p") - F.col("q")))
    range_ = t.groupBy("image_id").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    return t.join(range_, "image_id").select("image_id", "y", "x", F.coalesce((F.col("a") - F.col("lo")) * 255 / F.expr("nullif(hi - lo, 0)"), F.lit(0.0)).alias("d"))
