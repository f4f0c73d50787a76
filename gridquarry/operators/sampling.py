"""Seeded samples: weighted draws and patches of images.

Draws come from SHA-256, so they depend on the seed and the row alone: neither
on the plan, nor on the number of partitions, nor on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.sources.workspace import with_index, written


def uniform(seed: int, *parts: Column) -> Column:
    """A number above 0 and below 1, of 52 bits of the hash of seed and parts."""
    digest = F.sha2(F.concat_ws("/", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement: each next one is drawn with chances in
    proportion to ``weight`` among those left. Each row gets an exponential key
    of rate ``weight``, and the smallest keys are the sample: a range sort and
    a cut by place. Rows whose weight is null, not finite or not above 0 are
    never drawn; all others are where there are ``n`` at most."""
    sound = df.where((F.col(weight) > 0) & (F.col(weight) < float("inf")))
    keyed = sound.withColumn("_k", -F.log(uniform(seed, F.col(key))) / F.col(weight).cast("double"))
    return with_index(keyed, "_k", key, name="_place").where(F.col("_place") < n).drop("_k", "_place")


def coverage(images: DataFrame, size: int) -> DataFrame:
    """image_id, y, x of the patches of ``size`` pixels a side that cover each
    image (image_id, height, width) wholly; the last of a row or column is
    moved back inside, so that only there patches overlap. A side shorter than
    ``size`` has one patch, at 0."""

    def places(edge: str) -> Column:
        last = F.greatest(F.col(edge) - size, F.lit(0)).cast("bigint")
        return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.greatest(F.col(edge) - size, F.lit(0)) / size)), lambda i: F.least(i * size, last)))

    return images.select("image_id", F.explode(places("height")).alias("y"), "width").select("image_id", "y", F.explode(places("width")).alias("x"))


def drawn_patches(images: DataFrame, objects: DataFrame, draws: int, size: int, centred: float, seed: int = 0) -> DataFrame:
    """draw, image_id, y, x and label of ``draws`` patches, with replacement.

    ``images``: image_id, height, width, weight. A draw picks an image with
    chances in proportion to its weight; with chance ``centred`` it takes one
    of its objects (image_id, label, y, x: the centre; all alike) and lays the
    patch around it, as far as the image allows, else (or where there is none)
    a place in the image. Images with a null weight or none above 0 are never
    drawn. The cumulated weights are cut into as many equal bins as there are
    images; a draw meets the images of its bin alone.
    """
    sound = written(images.where((F.col("weight") > 0) & (F.col("weight") < float("inf"))).select("image_id", "height", "width", F.col("weight").cast("double").alias("weight")))
    n, total = sound.agg(F.count("*"), F.sum("weight")).first()
    spark = images.sparkSession
    if not n:
        return spark.createDataFrame([], "draw long, image_id long, y long, x long, label long")
    placed = written(with_index(sound, "image_id", name="_i").withColumn("_run", F.expr("_i div 4096")))
    # Sums of runs of 4096 images, then within the run.
    runs = placed.groupBy("_run").agg(F.sum("weight").alias("_w"))
    runs = with_index(runs, "_run", name="_r").select("_run", (F.sum("_w").over(W.partitionBy(F.expr("_r div 4096")).orderBy("_r")) - F.col("_w")).alias("_low"), F.expr("_r div 4096").alias("_block"))
    blocks = placed.withColumn("_block", F.expr("_run div 4096")).groupBy("_block").agg(F.sum("weight").alias("_b"))
    blocks = blocks.withColumn("_start", F.sum("_b").over(W.orderBy("_block")) - F.col("_b"))  # a row for 16 million images
    starts = runs.join(F.broadcast(blocks), "_block").select("_run", (F.col("_low") + F.col("_start")).alias("_low"))
    within = F.sum("weight").over(W.partitionBy("_run").orderBy("_i"))
    ranged = placed.join(starts, "_run").withColumn("_high", F.col("_low") + within).withColumn("_low", F.col("_high") - F.col("weight"))
    bin_of = lambda c: F.least(F.floor(c / F.lit(total) * n), F.lit(n - 1)).cast("bigint")
    ranged = ranged.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_low")), bin_of(F.col("_high")))))
    at = spark.range(draws).withColumnRenamed("id", "draw").withColumn("_at", uniform(seed, F.col("draw"), F.lit("image")) * total).withColumn("_bin", bin_of(F.col("_at")))
    chosen = at.join(ranged, "_bin").where("_at >= _low and _at < _high").select("draw", "image_id", "height", "width")
    numbered = objects.select("image_id", "label", F.col("y").alias("_y"), F.col("x").alias("_x"), (F.row_number().over(W.partitionBy("image_id").orderBy("label")) - 1).alias("_nth"))
    counts = objects.groupBy("image_id").agg(F.count("*").alias("_n"))
    aimed = chosen.join(counts, "image_id", "left").withColumn("_nth", F.when((uniform(seed, F.col("draw"), F.lit("object")) < centred) & (F.col("_n") > 0), F.floor(uniform(seed, F.col("draw"), F.lit("nth")) * F.col("_n")).cast("int")))
    met = aimed.join(numbered, ["image_id", "_nth"], "left")

    def placed_at(edge: str, centre: str, salt: str) -> Column:
        room = F.greatest(F.col(edge) - size, F.lit(0))
        free = F.floor(uniform(seed, F.col("draw"), F.lit(salt)) * (room + 1))
        return F.when(F.col("_nth").isNotNull(), F.least(F.greatest(F.floor(F.col(centre)) - size // 2, F.lit(0)), room)).otherwise(free).cast("bigint")

    return met.select("draw", "image_id", placed_at("height", "_y", "y").alias("y"), placed_at("width", "_x", "x").alias("x"), "label")
