"""Prediction, run-length and prefix coding of index matrices."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bits of the longest code that containers hold.
MOST_BITS = 32


def med_encode(indexed: DataFrame, size: DataFrame | None = None) -> DataFrame:
    """Median-edge prediction residuals: image_id, y, x, e = idx - prediction + size, a column of indexed or (image_id, size).

    The neighbours are lags within rows and within columns, so a large image is spread over many tasks.
    """
    row, column = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    t = (indexed if size is None else indexed.drop("size").join(size, "image_id")).select("image_id", "y", "x", "idx", "size").withColumn("n", F.lag("idx").over(column)).withColumn("w", F.lag("idx").over(row)).withColumn("nw", F.lag("n").over(row))
    inner = F.when(F.col("nw") >= F.greatest("w", "n"), F.least("w", "n")).when(F.col("nw") <= F.least("w", "n"), F.greatest("w", "n")).otherwise(F.col("w") + F.col("n") - F.col("nw"))
    guess = F.when((F.col("y") == 0) & (F.col("x") == 0), 0).when(F.col("y") == 0, F.col("w")).when(F.col("x") == 0, F.col("n")).otherwise(inner)
    return t.select("image_id", "y", "x", (F.col("idx") - guess + F.col("size")).cast("int").alias("e"))


def undo_med(e: np.ndarray) -> np.ndarray:
    """The matrix whose median-edge prediction residuals are e. Cells of one anti-diagonal don't depend on each other."""
    h, w = e.shape
    out = np.zeros((h + 1, w + 1), np.int64)  # a row above and a column before, of zeros
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        inner = np.where(c >= np.maximum(a, b), np.minimum(a, b), np.where(c <= np.minimum(a, b), np.maximum(a, b), a + b - c))
        out[y + 1, x + 1] = e[y, x] + np.where(y == 0, a, np.where(x == 0, b, inner))
    return out[1:, 1:]


def med_decode(residuals: DataFrame, size: DataFrame) -> DataFrame:
    """The index matrix of residuals. Each prediction needs decoded neighbours, so an image is decoded in one call."""

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), np.int64)
        e[pdf.y, pdf.x] = pdf.e - int(pdf["size"].iloc[0])
        return pdf[["image_id", "y", "x"]].assign(idx=undo_med(e)[pdf.y, pdf.x])

    return residuals.join(size, "image_id").groupBy("image_id").applyInPandas(decode, "image_id long, y int, x int, idx int")


def runs(values: DataFrame, column: str) -> DataFrame:
    """Run lengths in raster order, across row ends: image_id, run_no, value, len.

    Rows are collapsed first, each by itself; only one row of a row's first and last value is ordered by image.
    """
    t = values.select("image_id", "y", "x", F.col(column).alias("value"))
    row = W.partitionBy("image_id", "y").orderBy("x")
    t = t.withColumn("new", F.coalesce((F.col("value") != F.lag("value").over(row)).cast("int"), F.lit(1)))
    t = t.withColumn("part", F.sum("new").over(row.rowsBetween(W.unboundedPreceding, 0)))
    t = t.groupBy("image_id", "y", "part").agg(F.first("value").alias("value"), F.count("*").alias("len"))
    # a row's runs are counted by themselves; what it adds before the next row is known from its first and last value
    ends = t.groupBy("image_id", "y").agg(F.max("part").alias("parts"), F.min_by("value", "part").alias("head"), F.max_by("value", "part").alias("tail"))
    rows = W.partitionBy("image_id").orderBy("y")
    ends = ends.withColumn("joins", F.coalesce((F.col("head") == F.lag("tail").over(rows)).cast("long"), F.lit(0)))
    base = F.sum(F.col("parts") - F.col("joins")).over(rows.rowsBetween(W.unboundedPreceding, 0)) - F.col("parts")
    t = t.join(ends.select("image_id", "y", base.alias("base")), ["image_id", "y"]).withColumn("run_no", F.col("base") + F.col("part") - 1)
    return t.groupBy("image_id", "run_no").agg(F.first("value").alias("value"), F.sum("len").alias("len"))


def unrolled(runs: DataFrame, width: int) -> DataFrame:
    """Pixels of runs: image_id, y, x, value."""
    before = F.coalesce(F.sum("len").over(W.partitionBy("image_id").orderBy("run_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = runs.withColumn("start", before).select("image_id", "value", F.explode(F.expr("sequence(start, start + len - 1)")).alias("seq"))
    return t.select("image_id", F.expr(f"cast(seq div {width} as int)").alias("y"), F.expr(f"cast(seq % {width} as int)").alias("x"), "value")


def run_keys(runs: DataFrame) -> DataFrame:
    """Frequencies of the keys value * (longest run + 1) + len - 1: image_id, max_run, key, freq."""
    longest = runs.groupBy("image_id").agg(F.max("len").alias("max_run"))
    t = runs.join(longest, "image_id").withColumn("key", F.col("value") * (F.col("max_run") + 1) + F.col("len") - 1)
    return t.groupBy("image_id", "max_run", "key").agg(F.count("*").alias("freq"))


def code_table(freq: dict[int, int]) -> dict[int, tuple[int, int]]:
    """key -> (code, length) of a prefix code of least total length; ties by frequency, then by least key; a single key is code 0 of 1 bit.

    Where that needs more than MOST_BITS bits, frequencies are halved until it doesn't.
    """
    if len(freq) == 1:
        return {k: (0, 1) for k in freq}
    heap = [(n, k, k) for k, n in freq.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, k, left), (m, q, right) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (n + m, min(k, q), (left, right)))
    out, open_nodes = {}, [(heap[0][2], 0, 0)]
    while open_nodes:
        node, code, length = open_nodes.pop()
        if isinstance(node, tuple):
            open_nodes += [(node[0], code << 1, length + 1), (node[1], code << 1 | 1, length + 1)]
        else:
            out[node] = (code, length)
    if max(length for _, length in out.values()) > MOST_BITS:
        return code_table({k: (n + 1) // 2 for k, n in freq.items()})
    return out


def codes(keys: DataFrame) -> DataFrame:
    """Prefix codes of each image's key frequencies: image_id, key, code, len, freq."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        table = code_table(dict(zip(pdf.key.tolist(), pdf.freq.tolist(), strict=True)))
        return pdf[["image_id", "key", "freq"]].assign(code=[table[k][0] for k in pdf.key], len=[table[k][1] for k in pdf.key])

    return keys.groupBy("image_id").applyInPandas(assign, "image_id long, key long, freq long, code long, len int")


def code_bits(coded: DataFrame) -> DataFrame:
    """Bits and whole bytes of each image's coded runs."""
    t = coded.groupBy("image_id").agg(F.sum(F.col("freq") * F.col("len")).alias("bits"), F.count("*").alias("entries"))
    return t.withColumn("bytes", F.expr("(bits + 7) div 8"))


def section_sizes(palette: DataFrame, coded: DataFrame, descriptors: DataFrame, group: str, bits: int = 2) -> DataFrame:
    """Bytes of one layer's sections in its container: image_id, section_group, section, bytes.

    palette has a row an entry, coded a row a code (key, freq, len), descriptors a row an entry of the queue. A layer's
    fields are its tag, the residuals' range, bits an index, longest run, table entries, runs and bytes of the stream.
    """
    entries = palette.groupBy("image_id").agg((2 + 2 * F.count("*")).alias("palette"))
    stream = code_bits(coded).select("image_id", (9 * F.col("entries")).alias("table"), F.col("bytes").alias("runs"))
    queue = descriptors.groupBy("image_id").agg((F.expr(f"(count(*) * {bits} + 7) div 8") + 8 * F.sum(F.col("change").cast("long"))).alias("queue"))
    t = entries.join(stream, "image_id").join(queue, "image_id", "left")
    each = {"palette": F.col("palette"), "fields": F.lit(18), "table": F.col("table"), "runs": F.col("runs"), "gradients": 13 + F.coalesce("queue", F.lit(0))}
    t = t.select("image_id", F.explode(F.array(*(F.struct(F.lit(n).alias("section"), c.cast("long").alias("bytes")) for n, c in each.items()))).alias("s"))
    return t.select("image_id", F.lit(group).alias("section_group"), "s.section", "s.bytes")


def size_report(sections: DataFrame, pixels: DataFrame) -> DataFrame:
    """Each image's bytes by (section_group, section) with subtotals and the total, as bits a pixel, percent of the file and, of 24 bits a pixel, the ratio.

    A rollup of (image_id, section_group, section, bytes); pixels has a row a pixel.
    """
    t = sections.groupBy("image_id", "section_group", "section").agg(F.sum("bytes").alias("bytes"))
    t = t.rollup("image_id", "section_group", "section").agg(F.sum("bytes").alias("bytes")).where("image_id is not null")
    t = t.select("image_id", F.coalesce("section_group", F.lit("TOTAL")).alias("section_group"), F.coalesce("section", F.lit("ALL")).alias("section"), "bytes")
    t = t.join(pixels.groupBy("image_id").agg(F.count("*").alias("pixels")), "image_id")
    t = t.join(t.where("section_group = 'TOTAL'").select("image_id", F.col("bytes").alias("whole")), "image_id")
    bits = 8.0 * F.col("bytes")
    return t.select("image_id", "section_group", "section", "bytes", (bits / F.col("pixels")).alias("bits_a_pixel"), (100.0 * F.col("bytes") / F.col("whole")).alias("percent"), (24.0 * F.col("pixels") / bits).alias("ratio"))
