"""Filters of images by tiles with a halo, and what rests on them: tissue
masks and puncta.

A tile sees its own pixels and those of the halo around it; at an image's
border the picture is mirrored (or zero beyond it), so results don't depend on
the tiles. An image's extent is that of its pixels; a filter gives NaN where a
pixel it needs is missing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.sources.workspace import broadcast_if_small, shuffled, written

from .grids import PIXEL, components, otsu
from .spatial import plateau_maxima
from .tracks import suppress


def disk(radius: float, spacing: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """The offsets within a physical radius, as a footprint."""
    reach = [int(radius / s + 1e-9) for s in spacing]
    y, x = np.ogrid[-reach[0] : reach[0] + 1, -reach[1] : reach[1] + 1]
    return (y * spacing[0]) ** 2 + (x * spacing[1]) ** 2 <= radius**2 * (1 + 1e-12)


def bell(sigma: float, order: int = 0) -> np.ndarray:
    """Weights of a Gaussian cut at four deviations, or of its second derivative."""
    reach = int(4 * sigma + 0.5)
    x = np.arange(-reach, reach + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    w /= w.sum()
    return w if not order else w * (x**2 / sigma**4 - 1 / sigma**2)


def _along(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums along an axis; the array gets shorter by the weights."""
    return np.lib.stride_tricks.sliding_window_view(a, len(weights), axis) @ weights


def _over(a: np.ndarray, footprint: np.ndarray, how) -> np.ndarray:
    """``how`` of what a footprint covers; the array gets smaller by it."""
    seen = np.lib.stride_tricks.sliding_window_view(a, footprint.shape)
    return how(seen[..., footprint], axis=-1)


def _reach(op: str, size: float, spacing: tuple[float, float]) -> tuple[int, int]:
    if op in ("gaussian", "background", "log"):
        return tuple(len(bell(size / s)) // 2 for s in spacing)
    y, x = (n // 2 for n in disk(size, spacing).shape)
    return (y, x) if op == "median" else (2 * y, 2 * x)


def filtered(grid: DataFrame, channel: str, op: str, size: float, *, spacing: tuple[float, float] = (1.0, 1.0), border: str = "reflect", tile: int = 64) -> DataFrame:
    """image_id, y, x, value: a channel after ``op``, in units of ``spacing``.

    gaussian, background (the image less its Gaussian) and log (minus the
    Laplacian of the Gaussian times its variance) take a deviation; median,
    opening and closing take the radius of a disk.
    """
    if op not in ("gaussian", "background", "log", "median", "opening", "closing") or border not in ("reflect", "zero"):
        raise ValueError(f"unknown filter {op} or border {border}")
    ry, rx = _reach(op, size, spacing)
    foot = disk(size, spacing) if op in ("median", "opening", "closing") else None
    wy, wx = (bell(size / s) for s in spacing) if foot is None else (None, None)

    def apply(a: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The filter over a padded array, smaller by the reach."""
        if op == "median":
            return _over(a, foot, np.median)
        if foot is not None:
            first, second = (np.min, np.max) if op == "opening" else (np.max, np.min)
            once = _over(a, foot, first)
            if border == "zero":  # beyond the image there is nothing, whatever the first step gave
                my, mx = (n // 2 for n in foot.shape)
                once = np.where(inside[my : inside.shape[0] - my, mx : inside.shape[1] - mx], once, 0)
            return _over(once, foot, second)
        if op == "log":
            my, mx = (bell(size / s, 2) * (size / s) ** 2 for s in spacing)
            return -(_along(_along(a, my, 0), wx, 1) + _along(_along(a, wy, 0), mx, 1))
        smooth = _along(_along(a, wy, 0), wx, 1)
        return smooth if op == "gaussian" else a[ry : a.shape[0] - ry, rx : a.shape[1] - rx] - smooth

    extent = broadcast_if_small(grid.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")))
    at = lambda c, reach: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    spread = grid.select(*PIXEL, F.col(channel).cast("double").alias("v")).join(extent, "image_id").withColumn("ty", F.explode(at("y", ry))).withColumn("tx", F.explode(at("x", rx)))
    spread = spread.where("ty >= 0 and tx >= 0")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx, h, w = (int(pdf[c].iloc[0]) for c in ("ty", "tx", "h", "w"))
        y0, y1, x0, x1 = ty * tile, min(ty * tile + tile, h), tx * tile, min(tx * tile + tile, w)
        own = pdf[(pdf["y"] >= y0) & (pdf["y"] < y1) & (pdf["x"] >= x0) & (pdf["x"] < x1)]
        if own.empty:
            return pd.DataFrame({"image_id": [], "y": [], "x": [], "value": []})
        a0, a1, b0, b1 = max(y0 - ry, 0), min(y1 + ry, h), max(x0 - rx, 0), min(x1 + rx, w)
        a = np.full((a1 - a0, b1 - b0), np.nan)
        a[pdf["y"] - a0, pdf["x"] - b0] = pdf["v"]
        pad = ((a0 - (y0 - ry), y1 + ry - a1), (b0 - (x0 - rx), x1 + rx - b1))
        inside = np.pad(np.ones(a.shape, dtype=bool), pad)
        a = np.pad(a, pad, mode="symmetric") if border == "reflect" else np.pad(a, pad)
        out = apply(a, inside)
        return pd.DataFrame({"image_id": own["image_id"], "y": own["y"], "x": own["x"], "value": out[own["y"] - y0, own["x"] - x0]})

    return spread.groupBy("image_id", "ty", "tx").applyInPandas(run, "image_id bigint, y bigint, x bigint, value double")


def tissue_mask(grid: DataFrame, luminance: str, width: int, height: int, closing: float = 0, least: int = 0) -> DataFrame:
    """image_id, y, x, label of pixels darker than Otsu's threshold of their
    image, after a closing by a disk, in components of ``least`` pixels."""
    limits = otsu(grid, luminance)
    dark = grid.select(*PIXEL, luminance).join(limits, "image_id", "left").select(*PIXEL, F.coalesce((F.col(luminance) < F.col("threshold")).cast("int"), F.lit(0)).alias("m"))
    mask = filtered(dark, "m", "closing", closing, border="zero").where("value = 1") if closing else dark.where("m = 1")
    labelled = written(components(mask.select(*PIXEL), width, height))
    large = labelled.groupBy("image_id", "label").count().where(F.col("count") >= least)
    return labelled.join(large.drop("count"), ["image_id", "label"], "left_semi").select(*PIXEL, "label")


def puncta(grid: DataFrame, channel: str, width: int, height: int, *, sigma: float, response: float, raw: float, apart: float, aperture: float) -> DataFrame:
    """image_id, y, x, response, pixels, sum: bright spots. Plateau maxima of
    the LoG response above both thresholds, thinned by ``apart``; each pixel
    within ``aperture`` of one belongs to the nearest (of equal ones the first
    by rows), and pixels and sum of the channel are measured there."""
    strong = written(filtered(grid, channel, "log", sigma))
    tops = plateau_maxima(strong, "value", width, height).where(F.col("value") > response).join(grid.select(*PIXEL, channel), PIXEL).where(F.col(channel) > raw)
    # Images are laid out below each other, too far apart to meet.
    gap = height + int(apart) + 1
    number = (F.col("image_id") * height + F.col("y")) * width + F.col("x")
    spots = written(tops.select(*PIXEL, "value", number.alias("id")))
    kept = suppress(spots.select("id", F.col("x").cast("double").alias("x"), (F.col("y") + F.col("image_id") * gap).cast("double").alias("y"), F.col("value").alias("response")), apart)
    spots = spots.join(kept.select("id"), "id", "left_semi")
    around = [(a, b) for a in range(-int(aperture), int(aperture) + 1) for b in range(-int(aperture), int(aperture) + 1) if a * a + b * b <= aperture * aperture]
    steps = F.array(*(F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x"), F.lit(a * a + b * b).alias("far")) for a, b in around))
    claims = spots.select("image_id", "id", F.explode(steps).alias("at")).select("image_id", "id", "at.*")
    owned = claims.groupBy(*PIXEL).agg(F.min(F.struct("far", "id")).alias("best")).select(*PIXEL, F.col("best.id").alias("id"))
    measured = shuffled(owned).join(grid.select(*PIXEL, channel), PIXEL).groupBy("id").agg(F.count("*").alias("pixels"), F.round(F.sum(channel), 4).alias("sum"))
    return spots.join(measured, "id").select(*PIXEL, F.round("value", 6).alias("response"), "pixels", "sum")
