"""Index matrices brought up to twice their size: gaps take the palette entry nearest to the middle of their neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stencil import nearest_to_midpoint


def nearest_in_box(pairs: DataFrame, palette: DataFrame, margin: float = 5.0) -> DataFrame:
    """(image_id, a, b, idx): the colour nearest to the middle of a and b among both and those in their box.

    palette has image_id, idx and l, a, b. The box spans both colours and the margin on every axis. Ties take a,
    then b, then the least idx; squared distances that agree to six decimals tie, as those of a and b always do.
    Distinct pairs meet the entries in the slices of l that their box spans.
    """
    colour = lambda p: palette.select("image_id", F.col("idx").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in "lab"))
    t = pairs.select("image_id", F.col("a").alias("p"), F.col("b").alias("q")).distinct()
    slice_of = lambda c: F.floor(c / (2 * margin)).cast("int")
    t = t.join(colour("p"), ["image_id", "p"]).join(colour("q"), ["image_id", "q"])
    spanned = F.sequence(slice_of(F.least("p_l", "q_l") - margin), slice_of(F.greatest("p_l", "q_l") + margin))
    t = t.withColumn("slice", F.explode(spanned)).join(colour("n").withColumn("slice", slice_of(F.col("n_l"))), ["image_id", "slice"])
    inside, distance = F.lit(True), F.lit(0.0)
    for c in "lab":
        p, q, n = (F.col(f"{k}_{c}") for k in "pqn")
        inside = inside & n.between(F.least(p, q) - margin, F.greatest(p, q) + margin)
        distance = distance + (n - (p + q) / 2) * (n - (p + q) / 2)
    rank = F.when(F.col("n") == F.col("p"), 0).when(F.col("n") == F.col("q"), 1).otherwise(F.col("n") + 2)
    best = F.min_by("n", F.struct(F.round(distance, 6).alias("d"), rank.alias("k")))
    return t.where(inside).groupBy("image_id", "p", "q").agg(best.alias("idx")).select("image_id", F.col("p").alias("a"), F.col("q").alias("b"), "idx")


def _filled(samples: DataFrame, axis: str, first: int, size: int, palette: DataFrame, nearest: Callable) -> DataFrame:
    """samples (image_id, y, x, idx) spread along one axis to first, first + 2, ...; gaps between are filled, borders copied."""
    other = "y" if axis == "x" else "x"
    places = F.explode(F.array(*(F.struct((F.col(axis) * 2 + first + d).alias("to"), F.lit(role).alias("role")) for d, role in ((0, "own"), (1, "a"), (-1, "b")))))
    t = samples.select("image_id", other, "idx", places.alias("p")).select("image_id", other, "idx", "p.*").where(F.col("to").between(0, size - 1))
    t = t.groupBy("image_id", other, F.col("to").alias(axis)).agg(*(F.max(F.when(F.col("role") == r, F.col("idx"))).alias(r) for r in ("own", "a", "b")))
    t = t.withColumn("own", F.coalesce("own", F.when(F.coalesce(F.col("a") != F.col("b"), F.lit(False)), None).otherwise(F.coalesce("a", "b"))))
    near = nearest(t.where("own is null").select("image_id", "a", "b"), palette)
    return t.join(near, ["image_id", "a", "b"], "left").select("image_id", "y", "x", F.coalesce("own", "idx").cast("int").alias("idx"))


def upsample_index(small: DataFrame, palette: DataFrame, width: int, height: int, odd: bool = True, nearest: Callable = nearest_to_midpoint) -> DataFrame:
    """small (image_id, y, x, idx), sampled at odd or even places, as a width x height matrix: image_id, y, x, idx.

    Columns first, then rows. A gap between two samples takes nearest(pairs, palette), a border copies its only
    neighbour, and places of samples that small lacks are index 0.
    """
    first = 1 if odd else 0
    if width <= first or height <= first:
        raise ValueError("the matrix has no place for a sample")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit((n - 1 - first) // 2)))
    grid = small.select("image_id").distinct().withColumn("y", upto(height)).withColumn("x", upto(width))
    whole = grid.join(small.select("image_id", "y", "x", "idx"), ["image_id", "y", "x"], "left").fillna(0, ["idx"])
    return _filled(_filled(whole, "x", first, width, palette, nearest), "y", first, height, palette, nearest)


def upsample_index_older(small: DataFrame, palette: DataFrame, width: int, height: int) -> DataFrame:
    """The oldest rule for even samples: gaps as in upsample_index, but the far border differs.

    An odd side's last column (row) takes the one before it, sample or not; an even side's, which has no sample, is
    index 0.
    """

    def bordered(t: DataFrame, axis: str, size: int) -> DataFrame:
        if size % 2 == 0:
            return t.withColumn("idx", F.when(F.col(axis) == size - 1, 0).otherwise(F.col("idx")))
        other = "y" if axis == "x" else "x"
        last = t.where(F.col(axis) == size - 2).select("image_id", other, F.lit(size - 1).alias(axis), "idx")
        return t.where(F.col(axis) < size - 1).unionByName(last)

    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 2)))
    grid = small.select("image_id").distinct().withColumn("y", upto(height)).withColumn("x", upto(width))
    whole = grid.join(small.select("image_id", "y", "x", "idx"), ["image_id", "y", "x"], "left").fillna(0, ["idx"])
    wide = bordered(_filled(whole, "x", 0, width, palette, nearest_to_midpoint), "x", width)
    return bordered(_filled(wide, "y", 0, height, palette, nearest_to_midpoint), "y", height)
