"""Reconstructed colours moved at random between a cluster's centre and the blended colour, inside the cluster's sphere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import in_sphere, normal, uniform

_PLACE = ("cast(image_id as bigint)", "cast(y as bigint)", "cast(x as bigint)")


def _centred(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """pixels with the centre c_l, c_a, c_b of their cluster, its error, and the way d_l, d_a, d_b to their own colour."""
    centre = palette.select("image_id", "idx", *(F.col(c).alias(f"c_{c}") for c in "lab"), F.abs("error").alias("radius"))
    t = pixels.join(centre, ["image_id", "idx"])
    return t.select("*", *((F.col(c) - F.col(f"c_{c}")).alias(f"d_{c}") for c in "lab"))


def _placed(t: DataFrame) -> DataFrame:
    """The centre plus the vector m_l, m_a, m_b, which the radius bounds: image_id, y, x, l, a, b."""
    t = t.select("image_id", "y", "x", *(f"c_{c}" for c in "lab"), *(F.expr(e).alias(f"n_{c}") for c, e in zip("lab", in_sphere(("m_l", "m_a", "m_b"), "radius"), strict=True)))
    return t.select("image_id", "y", "x", *((F.col(f"c_{c}") + F.col(f"n_{c}")).alias(c) for c in "lab"))


def between(pixels: DataFrame, palette: DataFrame, seed: int, borders: DataFrame | None = None, bias: float = 0.85) -> DataFrame:
    """Colours at a uniform share of the way from the centre; at border pixels (image_id, y, x) the share is at least the bias.

    pixels: image_id, y, x, idx and the blended l, a, b; palette: image_id, idx, l, a, b, error.
    """
    t = _centred(pixels, palette).withColumn("t", F.expr(uniform(seed, *_PLACE)))
    if borders is not None:
        t = t.join(borders.select("image_id", "y", "x", F.lit(True).alias("near")), ["image_id", "y", "x"], "left")
        t = t.withColumn("t", F.when(F.col("near"), bias + F.col("t") * (1 - bias)).otherwise(F.col("t")))
    return _placed(t.select("*", *((F.col("t") * F.col(f"d_{c}")).alias(f"m_{c}") for c in "lab")))


def around_middle(pixels: DataFrame, palette: DataFrame, seed: int, bias: float = 0.6) -> DataFrame:
    """Colours drawn around a point of the way from the centre, by a normal distribution whose third sigma is the centre.

    A draw on the centre's far side is mirrored at the centre.
    """
    t = _centred(pixels, palette).withColumn("sigma", F.greatest(F.expr(f"{bias}D*sqrt(d_l*d_l + d_a*d_a + d_b*d_b)/3.0D"), F.lit(1e-4)))
    t = t.select("*", *(F.expr(f"{bias}D*d_{c} + sigma*{normal(seed + k, *_PLACE)}").alias(f"g_{c}") for k, c in enumerate("lab")))
    t = t.withColumn("side", F.when(F.expr("g_l*d_l + g_a*d_a + g_b*d_b") < 0, -1.0).otherwise(1.0))
    return _placed(t.select("*", *((F.col("side") * F.col(f"g_{c}")).alias(f"m_{c}") for c in "lab")))
