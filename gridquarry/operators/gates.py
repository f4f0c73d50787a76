"""Rectangle and polygon gates, and planar geometry of polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .population import finite


def axis(metric: str, log10: bool = False) -> Column:
    """The metric on a linear or log10 axis; null where it is missing or has
    no logarithm."""
    v = finite(F.col(metric).cast("double"))
    return F.when(v > 0, F.log10(v)) if log10 else v


def rectangle_gate(df: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], log_x: bool = False, log_y: bool = False) -> DataFrame:
    """``df`` with gate: inside, outside, missing or non_positive; edges are
    inside."""
    x0, x1, y0, y1 = bounds
    ax, ay = axis(x, log_x), axis(y, log_y)
    missing = finite(F.col(x).cast("double")).isNull() | finite(F.col(y).cast("double")).isNull()
    inside = ax.between(x0, x1) & ay.between(y0, y1)
    return df.withColumn("gate", F.when(missing, "missing").when(ax.isNull() | ay.isNull(), "non_positive").when(inside, "inside").otherwise("outside"))


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a simple polygon, edges included: even-odd rule
    by the sign of the cross product, with a test of each edge first."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(vertices, vertices[1:] + vertices[:1]):
        cross = (F.lit(bx - ax) * (y - ay)) - (F.lit(by - ay) * (x - ax))
        on_edge = on_edge | ((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
        if ay != by:
            spans = (y >= min(ay, by)) & (y < max(ay, by))
            left = cross > 0 if by > ay else cross < 0
            crossings = crossings + F.when(spans & left, 1).otherwise(0)
    return on_edge | (crossings % 2 == 1)


def polygon_gate(df: DataFrame, x: str, y: str, vertices: list[tuple[float, float]]) -> DataFrame:
    """``df`` with gate: inside, outside or missing."""
    ax, ay = axis(x), axis(y)
    return df.withColumn("gate", F.when(ax.isNull() | ay.isNull(), "missing").when(in_polygon(ax, ay, vertices), "inside").otherwise("outside"))


def gate_accounting(gated: DataFrame, *by: str) -> DataFrame:
    return gated.groupBy(*by, "gate").agg(F.count("*").alias("n"))


def marker_gates(df: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """``df`` with one boolean a marker: whether its metric is above the
    threshold, strictly; null where the metric is missing."""
    return df.withColumns({name: finite(F.col(metric).cast("double")) > at for name, (metric, at) in gates.items()})


def polygon_measures(vertices: DataFrame, shape: str = "shape", order: str = "i") -> DataFrame:
    """Area and centroid of each closed polygon of a table of vertices (x, y):
    the shoelace sum over each vertex and the next. A zero area has no centroid."""
    from pyspark.sql import Window as W

    w = W.partitionBy(shape).orderBy(order)
    whole = W.partitionBy(shape).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), F.coalesce(F.lead("y").over(w), F.first("y").over(whole))
    pairs = vertices.select(shape, "x", "y", nx.alias("nx"), ny.alias("ny")).withColumn("c", F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    sums = pairs.groupBy(shape).agg(F.sum("c").alias("a"), F.sum((F.col("x") + F.col("nx")) * F.col("c")).alias("sx"), F.sum((F.col("y") + F.col("ny")) * F.col("c")).alias("sy"))
    safe = F.when(F.col("a") != 0, 3 * F.col("a"))
    return sums.select(shape, F.round(F.abs("a") / 2, 4).alias("area"), F.round(F.col("sx") / safe, 4).alias("centroid_x"), F.round(F.col("sy") / safe, 4).alias("centroid_y"))


def polyline_lengths(points: DataFrame, line: str, order: list[str]) -> DataFrame:
    """Number of points and length of each line of a table of points (x, y)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(line).orderBy(*order)
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    return points.select(line, step.alias("step")).groupBy(line).agg(F.count("*").alias("points"), F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 4).alias("length"))
