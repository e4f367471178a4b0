"""Quantisation: buckets, clusters of neighbouring buckets, palettes and index matrices."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import bits_per_index


def bucketed(planes: DataFrame, epsilon: float) -> DataFrame:
    """planes with the bucket k of v."""
    if not epsilon > 0:
        raise ValueError("epsilon must be above 0")
    return planes.withColumn("k", F.floor(F.col("v") / F.lit(float(epsilon))).cast("int"))


def _bucket_keys(epsilon: tuple[float, float, float]) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(float(e))).cast("int").alias(f"k{c}") for c, e in zip("lab", epsilon, strict=True)]


def voxelled(lab: DataFrame, epsilon: tuple[float, float, float]) -> DataFrame:
    """Pixels (l, a, b) with their 3-D bucket kl, ka, kb."""
    return lab.select("*", *_bucket_keys(epsilon))


def colour_palette(indexed: DataFrame) -> DataFrame:
    """Mean colour of each cluster and its pixels' greatest distance from it: image_id, idx, l, a, b, error."""
    mean = indexed.groupBy("image_id", "idx").agg(*(F.avg(c).alias(f"m{c}") for c in "lab"))
    distance = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), F.lit(2.0)) for c in "lab"), F.lit(0.0)))
    t = indexed.join(mean, ["image_id", "idx"]).groupBy("image_id", "idx", *(f"m{c}" for c in "lab")).agg(F.max(distance).alias("error"))
    return t.select("image_id", "idx", *(F.col(f"m{c}").alias(c) for c in "lab"), "error")


def voxels(lab: DataFrame, epsilon: tuple[float, float, float]) -> DataFrame:
    """Occupied 3-D buckets of pixels (image_id, l, a, b): kl, ka, kb, n and sums."""
    return lab.groupBy("image_id", *_bucket_keys(epsilon)).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in "lab"))


def bounded_runs(planes: DataFrame, epsilon: float, steps: int) -> tuple[DataFrame, DataFrame]:
    """Clusters of neighbouring 1-D buckets: (image_id, k, idx, size), size being the image's clusters, and the palette (image_id, idx, value, n).

    Each maximal run of occupied buckets is cut into blocks of steps + 1, the form that a bounded breadth-first
    cover takes from ascending roots. Windows run over occupied buckets, not pixels.
    """
    v = bucketed(planes, epsilon).groupBy("image_id", "k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    v = v.withColumn("island", F.col("k") - F.row_number().over(W.partitionBy("image_id").orderBy("k")))
    v = v.withColumn("block", F.expr(f"(row_number() over (partition by image_id, island order by k) - 1) div {steps + 1}"))
    v = v.withColumn("idx", (F.dense_rank().over(W.partitionBy("image_id").orderBy("island", "block")) - 1).cast("int"))
    palette = v.groupBy("image_id", "idx").agg((F.sum("s") / F.sum("n")).alias("value"), F.sum("n").alias("n"))
    size = F.max("idx").over(W.partitionBy("image_id")) + 1
    return v.select("image_id", "k", "idx", size.alias("size")), palette


def direct(planes: DataFrame, epsilon: float) -> DataFrame:
    """One palette entry per bucket, ascending: image_id, k, idx, value, error, n."""
    p = bucketed(planes, epsilon).groupBy("image_id", "k").agg(F.avg("v").alias("value"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    idx = (F.dense_rank().over(W.partitionBy("image_id").orderBy("k")) - 1).cast("int")
    return p.select("image_id", "k", idx.alias("idx"), "value", F.greatest(F.col("value") - F.col("lo"), F.col("hi") - F.col("value")).alias("error"), "n")


def error_summary(palette: DataFrame, pixels: DataFrame) -> DataFrame:
    """Per image the mean and the greatest of its entries' errors, pixels an entry and bits an index: image_id, mean_error, worst_error, reduction, index_bits."""
    entries = palette.groupBy("image_id").agg(F.avg("error").alias("mean_error"), F.max("error").alias("worst_error"), F.count("*").alias("entries"))
    sizes = pixels.groupBy("image_id").agg(F.count("*").alias("pixels"))
    return entries.join(sizes, "image_id").select("image_id", "mean_error", "worst_error", (F.col("pixels") / F.col("entries")).alias("reduction"), F.expr(bits_per_index("entries")).alias("index_bits"))


def numbered_voxels(indexed: DataFrame) -> DataFrame:
    """Voxelled pixels with idx, the rank of their bucket in its image: each bucket is its own cluster."""
    kinds = indexed.select("image_id", "kl", "ka", "kb").distinct()
    rank = (F.row_number().over(W.partitionBy("image_id").orderBy("kl", "ka", "kb")) - 1).alias("idx")
    return indexed.join(kinds.select("*", rank), ["image_id", "kl", "ka", "kb"])


def index_matrix(planes: DataFrame, clusters: DataFrame, epsilon: float) -> DataFrame:
    """planes with the cluster idx of each pixel (and its image's size), by an equi-join on the bucket."""
    return bucketed(planes, epsilon).join(clusters, ["image_id", "k"]).drop("k")


def decoded(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """indexed with the palette's value as `recon`."""
    return indexed.join(palette.select("image_id", "idx", F.col("value").alias("recon")), ["image_id", "idx"])


def cover(voxels: DataFrame, steps: int) -> DataFrame:
    """Bounded breadth-first cover of 3-D buckets: image_id, kl, ka, kb, cluster.

    Roots in ascending (kl, ka, kb), 26 neighbours, each bucket claimed once, up to `steps` away. The
    claims depend on each other, so an image's occupied buckets (not its pixels) meet in one Python call.
    """
    around = [d for d in product((-1, 0, 1), repeat=3) if any(d)]

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(map(tuple, pdf[["kl", "ka", "kb"]].to_numpy().tolist()))
        left, owner, n = set(keys), {}, 0
        for root in keys:
            if root not in left:
                continue
            left.remove(root)
            edge = [root]
            owner[root] = n
            for _ in range(steps):
                fresh = []
                for k, a, b in edge:
                    for dk, da, db in around:
                        near = (k + dk, a + da, b + db)
                        if near in left:
                            left.remove(near)
                            owner[near] = n
                            fresh.append(near)
                edge = fresh
            n += 1
        out = pd.DataFrame(list(owner), columns=["kl", "ka", "kb"])
        out.insert(0, "image_id", pdf["image_id"].iloc[0])
        return out.assign(cluster=list(owner.values()))

    return voxels.select("image_id", "kl", "ka", "kb").groupBy("image_id").applyInPandas(claim, "image_id long, kl int, ka int, kb int, cluster int")

