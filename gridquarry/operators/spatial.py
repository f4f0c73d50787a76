"""Distances to boundaries, bands, polygon regions, tiles and user functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.sources.workspace import shuffled, written

from .gates import in_polygon
from .grids import PIXEL, components, neighbours


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def boundary_distances(points: DataFrame, boundary: DataFrame, key: str, most: float) -> DataFrame:
    """Distance of each point (image_id, y, x) to the nearest boundary pixel of
    its image, null beyond ``most``. Squares of that size make it an equi-join."""
    at = lambda c: F.floor(F.col(c) / most).cast("bigint")
    a = points.select("image_id", key, F.col("y").alias("y1"), F.col("x").alias("x1"), at("y").alias("cy"), at("x").alias("cx"))
    around = F.array(*(F.struct((at("y") + i).alias("cy"), (at("x") + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = boundary.select("image_id", F.col("y").alias("y2"), F.col("x").alias("x2"), F.explode(around).alias("c")).select("image_id", "y2", "x2", "c.*")
    far = F.sqrt((F.col("y1") - F.col("y2")) ** 2 + (F.col("x1") - F.col("x2")) ** 2)
    met = a.join(shuffled(b), ["image_id", "cy", "cx"]).withColumn("far", far).where(F.col("far") <= most).groupBy("image_id", key).agg(F.min("far").alias("distance"))
    return points.select("image_id", key).join(met, ["image_id", key], "left")


def band_densities(images: DataFrame, compartment: DataFrame, centres: DataFrame, boundary: DataFrame, edges: list[float], pixel_area: float) -> DataFrame:
    """image_id, band, pixels, area, objects, density: of each band of distance
    to the boundary (from an edge to before the next), the compartment's pixels
    and the objects whose centre is one of them. Empty bands stay, with a null
    density."""
    number = F.struct("y", "x")
    own = compartment.select("image_id", "y", "x", number.alias("key"))
    far = written(boundary_distances(own, boundary, "key", edges[-1]).where("distance is not null").select("image_id", "key.y", "key.x", "distance"))
    band = sum((F.col("distance") >= e).cast("int") for e in edges[1:-1])
    placed = far.where((F.col("distance") >= edges[0]) & (F.col("distance") < edges[-1])).withColumn("band", band)
    pixels = placed.groupBy("image_id", "band").agg(F.count("*").alias("pixels"))
    objects = placed.join(centres.select("image_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x")), PIXEL).groupBy("image_id", "band").agg(F.count("*").alias("objects"))
    bands = images.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))))
    both = bands.join(pixels, ["image_id", "band"], "left").join(objects, ["image_id", "band"], "left").fillna(0, ["pixels", "objects"]).withColumn("area", F.col("pixels") * pixel_area)
    return both.select("image_id", F.col("band").cast("bigint").alias("band"), "pixels", "area", "objects", r(F.try_divide("objects", "area")).alias("density"))


def sampled_histograms(voxels: DataFrame, index: str, channels: list[str], most: int, bins: int) -> DataFrame:
    """channel, n, p1, p99, bin, voxels: of each channel, over at most ``most``
    voxels at even steps of their index, the 1st and 99th percentile and the
    voxels in each of ``bins`` equal bins between the ends (empty ones left out)."""
    last = voxels.agg(F.max(index)).first()[0]
    if last is None:
        last = 0
    step = F.ceil(F.col(index) * (most - 1) / F.lit(max(last, 1))).cast("bigint")
    hit = lambda k: F.floor((k * last) / F.lit(most - 1)).cast("bigint") == F.col(index)
    # Rounding may put the step one off, on either side.
    picked = voxels.where(F.exists(F.array(step - 1, step, step + 1), lambda k: (k >= 0) & (k < most) & hit(k)))
    long = picked.select(*(F.col(c).cast("double").alias(c) for c in channels)).unpivot([], channels, "channel", "value")
    ends = long.groupBy("channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"), F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    at = F.coalesce(F.least(F.floor(F.try_divide((F.col("value") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1)), F.lit(0)).cast("int")
    return long.where("value is not null").join(F.broadcast(ends), "channel").groupBy("channel", "n", r(F.col("p")[0]).alias("p1"), r(F.col("p")[1]).alias("p99"), at.alias("bin")).agg(F.count("*").alias("voxels"))


def display_statistics(grid: DataFrame, channel: str, width: int, strata: int, bins: int) -> DataFrame:
    """image_id, low, high (1st and 99th percentile of a sample: of ``strata``
    equal runs of pixels, the one with the smallest hash), least, greatest (of
    all pixels), bin, n: the sample's values between low and high, clipped, in
    equal bins."""
    index = F.col("y") * width + F.col("x")
    own = grid.select("image_id", index.alias("i"), F.col(channel).alias("v"))
    whole = own.groupBy("image_id").agg(F.max("i").alias("last"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    key = F.sha2(F.concat_ws("/", F.col("image_id").cast("string"), F.col("i").cast("string")), 256)
    sample = own.join(whole, "image_id").groupBy("image_id", "least", "greatest", F.expr(f"i * {strata} div (last + 1)").alias("stratum")).agg(F.min_by("v", key).alias("v"))
    ends = sample.groupBy("image_id").agg(F.percentile("v", F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    low, high = F.col("p")[0], F.col("p")[1]
    scaled = F.coalesce(F.greatest(F.least(F.try_divide(F.col("v") - low, high - low), F.lit(1.0)), F.lit(0.0)), F.lit(0.0))
    at = F.least(F.floor(F.round(scaled, 9) * bins), F.lit(bins - 1)).cast("int")
    return sample.join(ends, "image_id").groupBy("image_id", r(low).alias("low"), r(high).alias("high"), "least", "greatest", at.alias("bin")).agg(F.count("*").alias("n"))


def nearest_boundary(points: DataFrame, boundary: DataFrame, key: str, size: float) -> DataFrame:
    """Distance of each point (image_id, y, x) to the nearest boundary pixel of
    its image, however far; null only where the image has none (or the point no
    place). Points without one within ``size`` look again in squares twice as large."""
    placed = lambda df: df.where("abs(y) < double('infinity') and abs(x) < double('infinity')")
    boundary = placed(boundary)
    left = written(placed(points).where(F.col(key).isNotNull()).join(boundary.select("image_id").distinct(), "image_id", "left_semi").select("image_id", key, "y", "x"))
    settled = points.sparkSession.createDataFrame([], points.select("image_id", key).schema).withColumn("distance", F.lit(None).cast("double"))
    while not left.isEmpty():
        met = written(boundary_distances(left, boundary, key, size).where("distance is not null"))
        settled = settled.union(met)
        left = written(left.join(met, ["image_id", key], "left_anti"))
        size *= 2
    return points.select("image_id", key).join(settled, ["image_id", key], "left")


def polygon_measures(grid: DataFrame, polygons: dict[str, list[tuple[float, float]]], channel: str) -> DataFrame:
    """Per image and polygon: pixels whose centre lies inside, and mean, sum,
    least and greatest of a channel. Each polygon's box is a range filter that
    reaches the scan; only then are its edges tested."""
    parts = []
    for name, vertices in polygons.items():
        xs, ys = zip(*vertices)
        box = F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys))
        parts.append(F.when(box & in_polygon(F.col("x").cast("double"), F.col("y").cast("double"), vertices), F.lit(name)))
    inside = grid.select("image_id", channel, F.explode(F.array_compact(F.array(*parts))).alias("region"))
    return inside.groupBy("image_id", "region").agg(F.count("*").alias("pixels"), r(F.avg(channel)).alias("mean"), r(F.sum(channel), 4).alias("sum"), F.min(channel).alias("least"), F.max(channel).alias("greatest"))


def plateau_maxima(grid: DataFrame, channel: str, width: int, height: int) -> DataFrame:
    """One pixel of each plateau: of connected pixels (of eight neighbours)
    that no neighbour exceeds, the first by rows. They are equally high."""
    own = grid.select(*PIXEL, channel)
    beaten = neighbours(own, [channel], diagonal=True).where(F.col(f"n_{channel}") > F.col(channel)).select(*PIXEL).distinct()
    tops = written(own.join(beaten, PIXEL, "left_anti"))
    labelled = components(tops.select(*PIXEL), width, height, diagonal=True)
    firsts = labelled.groupBy("image_id", "label").agg(F.min(F.struct("y", "x")).alias("at")).select("image_id", "at.*")
    return tops.join(firsts, PIXEL, "left_semi")


def to_tiles(grid: DataFrame, channel: str, size: int) -> DataFrame:
    """The grid as tiles of ``size`` x ``size`` pixels: image_id, ty, tx, h, w
    and the values by rows; a tile's size bounds what a row gathers."""
    t = grid.withColumns({"ty": F.expr(f"y div {size}"), "tx": F.expr(f"x div {size}")})
    values = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", F.col(channel).alias("v")))), lambda s: s["v"])
    return t.groupBy("image_id", "ty", "tx").agg((F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"), values.alias("pixels"))


def from_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """Pixels (image_id, y, x, v) of whole tiles."""
    p = tiles.select("image_id", "ty", "tx", "w", F.posexplode("pixels").alias("i", "v"))
    return p.select("image_id", (F.col("ty") * size + F.expr("i div w")).alias("y"), (F.col("tx") * size + F.expr("i % w")).alias("x"), "v")


def per_image(grid: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function over the rows of each image; the image is the bound
    of what a task holds."""
    return grid.groupBy("image_id").applyInPandas(function, schema)


def per_tile(grid: DataFrame, channel: str, model: Callable, size: int, halo: int) -> DataFrame:
    """A model over tiles with a halo: each pixel goes to every tile that sees
    it, the model takes a padded array and gives one of the same shape, and
    only the tile's own pixels are kept."""
    import numpy as np

    span = range(-halo, halo + 1, max(1, halo)) if halo else [0]
    seen = F.array_distinct(F.array(*(F.struct(F.floor((F.col("y") + i) / size).alias("ty"), F.floor((F.col("x") + j) / size).alias("tx")) for i in span for j in span)))
    spread = grid.select(*PIXEL, F.col(channel).alias("v"), F.explode(seen).alias("t")).select(*PIXEL, "v", "t.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        a = np.full((int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1), np.nan)
        a[pdf["y"] - y0, pdf["x"] - x0] = pdf["v"]
        out = model(a)
        own = pdf[(pdf["y"] // size == ty) & (pdf["x"] // size == tx)]
        return pd.DataFrame({"image_id": own["image_id"], "y": own["y"], "x": own["x"], "value": out[own["y"] - y0, own["x"] - x0]})

    return spread.groupBy("image_id", "ty", "tx").applyInPandas(run, "image_id bigint, y bigint, x bigint, value double")
