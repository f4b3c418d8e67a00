"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

The share of source s at time t in [0, 1] is target_s * (1 + slope_s * (2t - 1)); its integral, the demand up to t, is
target_s * (t + slope_s * (t*t - t)). A source's documents stand in the order of md5(id); the words before a document in
that order, added over buckets of the md5 first and within each bucket then, are inverted through the demand to its
position in the training order. No window holds more than one bucket of one source, so that a source with a third of all
rows is spread over as many tasks as its size asks for.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, after all others. A
target equals the sum of what its documents take, rounded to a word: at most one document in a source is cut. Ids that
repeat share the order by size; rows alike in id, source and size are interchangeable. Without any words every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.shared import cut, word_count

#: Fixed values of the default mix: weights repeat over the sources, slopes too (falling, level, rising shares).
WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.0, 0.5)


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, slopes: tuple = SLOPES) -> DataFrame:
    """(source, source_size) -> also target and slope. Water filling: sources that reach `most` times their size are
    capped in the order of cap / weight; the rest share what is left by weight. The table has a row for each source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.pmod(F.row_number().over(order) - 1, F.lit(len(values))) + 1)
    rows = sources.select("source", "source_size", pick(weights).alias("weight"), pick(slopes).alias("slope"), (F.col("source_size") * most).alias("cap"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = Window.orderBy("ratio", F.col("source").isNull(), "source")
    all_ = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(all_) * share - before) / left)
    # The level rises as long as capping a source leaves more to the rest, and falls after that.
    rows = rows.withColumn("level", F.max("level").over(all_))
    return rows.select("source", "source_size", "slope", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def position(words: Column, target: Column, slope: Column) -> Column:
    """The time by which the demand of a source reaches `words`."""
    x, b = words / target, 1 - slope
    root = (F.sqrt(F.greatest(b * b + 4 * slope * x, F.lit(0.0))) - b) / (2 * slope) + 0.0
    return F.when(target > 0, F.when(slope == 0, x).otherwise(root))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, ordered: bool = True, row_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position and again (where the second taking of a document
    stands, if there is one), sorted by position; and row_col (a number of the row, which settles the order of rows
    alike in id and size) where it is named."""
    number = [row_col] if row_col else []
    size = word_count(F.col(text_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *number)
    base = cut(base.withColumn("rank", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "sizes")
    # As many buckets as each has rows at most: neither the sums of a source's buckets nor a bucket outgrows a task.
    buckets = max(16, math.isqrt(base.count()))
    # The first 8 hexadecimal digits of the md5, scaled: buckets follow the order of the md5.
    bucket = (F.conv(F.substring("rank", 1, 8), 16, 10).cast("long") * buckets / 2.0**32).cast("long")
    base = base.withColumn("bucket", bucket).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sums = base.groupBy("key", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = cut(sums.withColumn("before", F.sum("bucket_size").over(Window.partitionBy("key").orderBy("bucket")) - F.col("bucket_size")), "buckets")
    per_source = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, most, weights, slopes)
    per_source = per_source.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source_size", "target", "slope")
    offsets = sums.select("key", "bucket", "before").join(per_source, "key")
    own = Window.partitionBy("key", "bucket").orderBy("rank", "doc_id", "size", *number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = base.withColumn("within", F.sum("size").over(own) - F.col("size")).join(offsets, ["key", "bucket"])
    start = F.col("before") + F.col("within")
    whole = F.round("target").cast("long")
    take = lambda first: F.greatest(F.least(whole - first, F.col("size")), F.lit(0))
    once, twice = take(start), take(start + F.col("source_size"))
    rows = rows.select(
        "doc_id", "source", "size", "source_size", "target", (once + twice).cast("long").alias("taken"),
        F.when(once > 0, position(start, F.col("target"), F.col("slope"))).alias("position"),
        F.when(twice > 0, position(start + F.col("source_size"), F.col("target"), F.col("slope"))).alias("again"),
        *number,
    )
    return rows.orderBy(F.col("position").isNull(), "position", "doc_id") if ordered else rows
