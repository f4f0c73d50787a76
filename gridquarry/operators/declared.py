"""Declared pipelines: a validated list of steps, run as DataFrame transforms."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters, grids, population

#: Steps in the order in which they must stand; only ``process`` may repeat or lack.
ORDER = ("source", "process", "segment", "measure", "population", "review", "export")
#: Fields of each step; those after a bar may be left out.
FIELDS = {
    "source": "channel|",
    "process": "filter|size value clip_negative",
    "segment": "at_least|connect",
    "measure": "|channels",
    "population": "ranges|",
    "review": "least_pixels|",
    "export": "columns|",
}


def validated(text: str) -> list[dict]:
    """The steps of a JSON declaration. Refused are unknown steps and fields,
    missing fields, keys given twice, numbers that aren't finite and any other
    order."""

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key is given twice")
        return dict(pairs)

    def refused(name: str):
        raise ValueError(f"{name} isn't a number")

    steps = json.loads(text, object_pairs_hook=once, parse_constant=refused)
    if not isinstance(steps, list) or not all(isinstance(s, dict) for s in steps):
        raise ValueError("a declaration is a list of steps")
    for s in steps:
        if s.get("step") not in FIELDS:
            raise ValueError(f"unknown step {s.get('step')}")
        needed, _, more = FIELDS[s["step"]].partition("|")
        if missing := set(needed.split()) - set(s):
            raise ValueError(f"{s['step']} lacks {sorted(missing)}")
        if unknown := set(s) - {"step", *needed.split(), *more.split()}:
            raise ValueError(f"{s['step']} doesn't know {sorted(unknown)}")
    names = [s["step"] for s in steps]
    if [n for n in names if n != "process"] != [n for n in ORDER if n != "process"] or names != sorted(names, key=ORDER.index):
        raise ValueError("steps are " + ", ".join(ORDER) + ", in this order")
    return steps


def _processed(grid: DataFrame, step: dict) -> DataFrame:
    if step["filter"] == "subtract":
        out = grid.withColumn("value", F.col("value") - float(step["value"]))
    else:
        out = filters.filtered(grid, "value", step["filter"], float(step["size"]))
    return out.withColumn("value", F.greatest("value", F.lit(0.0))) if step.get("clip_negative") else out


def run(grid: DataFrame, declaration: str, width: int, height: int) -> DataFrame:
    """The exported rows of a declared pipeline over a grid (image_id, y, x,
    channels)."""
    raw = grid
    for s in validated(declaration):
        kind = s["step"]
        if kind == "source":
            grid = grid.select(*grids.PIXEL, F.col(s["channel"]).cast("double").alias("value"))
        elif kind == "process":
            grid = _processed(grid, s)
        elif kind == "segment":
            grid = grids.components(grid.where(F.col("value") >= float(s["at_least"])).select(*grids.PIXEL), width, height, diagonal=s.get("connect") == 8)
        elif kind == "measure":
            channels = s.get("channels", [])
            objects = grids.object_measures(grid.join(raw.select(*grids.PIXEL, *channels), grids.PIXEL), channels, width, height)
        elif kind == "population":
            objects = population.range_filters(objects, {m: tuple(r) for m, r in s["ranges"].items()})
        elif kind == "review":
            objects = objects.withColumn("review", F.when(F.col("pixels") >= int(s["least_pixels"]), "accepted").otherwise("needs-review"))
        else:
            objects = objects.select(*s["columns"])
    return objects
