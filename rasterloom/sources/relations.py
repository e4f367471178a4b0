"""Pixel relations derived from the supplied tables, and image files as pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Order keys of one coarse bucket when a table is laid out as a raster.
COARSE = 1024


def planes_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 plane: image_id, y, x, v."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    return e.select(F.col("vec_id").alias("image_id"), F.expr("cast(p div 8 as int)").alias("y"), (F.col("p") % 8).alias("x"), F.col("e").cast("double").alias("v"))


def rgb_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 RGB image, every element in each channel, a third of the row apart: image_id, y, x, r, g, b."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    byte = lambda c: F.expr(f"cast(floor(least(1d, greatest(0d, cast(embedding[(p + {c}) % 64] as double) + 0.5d)) * 255) as int)")
    return e.select(F.col("vec_id").alias("image_id"), F.expr("cast(p div 8 as int)").alias("y"), (F.col("p") % 8).alias("x"), byte(0).alias("r"), byte(21).alias("g"), byte(42).alias("b"))


def raster_of_lineitem(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    """lineitem in its total order as one RGB raster: image_id 0, y, x, r, g, b.

    Rows are numbered in coarse key ranges. Ranges' counts are summed in order within blocks of ranges, and only the
    blocks' sums, a millionth of the rows, by one task.
    """
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*keys, "l_quantity", "l_discount", "l_tax").withColumn("range", F.expr(f"l_orderkey div {COARSE}"))
    counts = t.groupBy("range").count().withColumn("block", F.expr(f"range div {COARSE}"))
    inside = F.sum("count").over(W.partitionBy("block").orderBy("range")) - F.col("count")
    blocks = counts.groupBy("block").agg(F.sum("count").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("base"))
    before = counts.withColumn("inside", inside).join(blocks, "block").select("range", (F.col("base") + F.col("inside")).alias("before"))
    n = F.row_number().over(W.partitionBy("range").orderBy(*keys)) - 1 + F.col("before")
    t = t.join(before, "range").withColumn("n", n)
    return t.select(
        F.lit(0).cast("long").alias("image_id"), F.expr(f"cast(n div {width} as int)").alias("y"), F.expr(f"cast(n % {width} as int)").alias("x"),
        F.expr("cast(l_quantity * 5 as int)").alias("r"), F.expr("cast(round(l_discount * 100) * 25 as int)").alias("g"), F.expr("cast(round(l_tax * 100) * 31 as int)").alias("b"),
    )


def planes_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values in time order as a one-row plane."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
    x = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("image_id"), F.lit(0).alias("y"), x.alias("x"), F.col("value").cast("double").alias("v"))


def image_pixels(images: DataFrame) -> DataFrame:
    """Pixels of Spark's image source (rows of `image` with BGR(A) or grey bytes): image_id, y, x, r, g, b; alpha is dropped.

    image_id is the number that a file's name is, else a hash of its path.
    """
    number = F.expr(r"try_cast(regexp_extract(image.origin, '([0-9]+)[.][A-Za-z]+$', 1) as bigint)")
    i = images.select(F.coalesce(number, F.xxhash64("image.origin")).alias("image_id"), "image.width", "image.nChannels", "image.data", F.explode(F.expr("sequence(0, image.width * image.height - 1)")).alias("p"))
    byte = lambda c: F.expr(f"cast(conv(hex(substring(data, p * nChannels + 1 + {c}, 1)), 16, 10) as int)")
    of = lambda c: F.when(F.col("nChannels") >= 3, byte(c)).otherwise(byte(0))
    return i.select("image_id", F.expr("cast(p div width as int)").alias("y"), (F.col("p") % F.col("width")).alias("x"), of(2).alias("r"), of(1).alias("g"), of(0).alias("b"))
