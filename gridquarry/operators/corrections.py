"""Ordered corrections of label grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.sources.workspace import broadcast_if_small, written

from . import grids

# The kinds of corrections, and how many a session has at most.
KINDS = ("paint", "erase", "polygon_add", "polygon_replace", "merge", "delete")
MOST = 64

SCHEMA = "image_id bigint, seq bigint, op string, label bigint, labels array<bigint>, points array<struct<x:double,y:double>>, radius double"


def _sides(points: Column, closed: bool) -> Column:
    """Pairs of neighbouring points; of one point, itself twice."""
    after = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, F.lit(1), F.lit(1))) if closed else F.when(F.size(points) > 1, F.slice(points, F.lit(2), F.size(points) - 1)).otherwise(points)
    before = points if closed else F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(1)))
    return F.arrays_zip(before.alias("a"), after.alias("b"))


def _inside(points: Column, x: Column, y: Column) -> Column:
    """Whether a place lies in a polygon (odd crossings) or on its edge."""

    def crossed(s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        return ((ay > y) != (by > y)) & (x < (bx - ax) * F.try_divide(y - ay, by - ay) + ax)

    def touched(s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        return ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    sides = _sides(points, True)
    return F.exists(sides, touched) | (F.size(F.filter(sides, lambda s: F.coalesce(crossed(s), F.lit(False)))) % 2 == 1)


def _under(points: Column, radius: Column, x: Column, y: Column) -> Column:
    """Whether a place is at most ``radius`` from a path."""

    def near(s: Column) -> Column:
        ax, ay, dx, dy = s["a"]["x"], s["a"]["y"], s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        along = F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
        along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        return (x - ax - along * dx) ** 2 + (y - ay - along * dy) ** 2 <= radius * radius

    return F.exists(_sides(points, False), near)


def _covered(o: Column, x: Column, y: Column) -> Column:
    brush = o["op"].isin("paint", "erase")
    reach = F.when(brush, o["radius"]).otherwise(0.0)
    box = x.between(o["x0"] - reach, o["x1"] + reach) & y.between(o["y0"] - reach, o["y1"] + reach)
    mask = F.when(brush, _under(o["points"], o["radius"], x, y)).when(o["op"].startswith("polygon"), _inside(o["points"], x, y))
    return F.coalesce(box & mask, F.lit(False))


def _after(o: Column, now: Column, covered: Column) -> Column:
    kind, label = o["op"], o["label"]
    return (
        F.when(kind.isin("paint", "polygon_add") & covered, label).when((kind == "erase") & covered & (now == label), F.lit(0).cast("bigint"))
        .when(kind == "polygon_replace", F.when(covered, label).when(now == label, F.lit(0).cast("bigint")).otherwise(now))
        .when((kind == "merge") & F.array_contains(o["labels"], now), label).when((kind == "delete") & (now == label), F.lit(0).cast("bigint")).otherwise(now)
    )


def correct_labels(grid: DataFrame, operations: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """The grid (image_id, y, x, label) after each image's corrections, in the
    order of seq, and a verdict for each correction: image_id, seq, op,
    changed (pixels), verdict.

    ``operations``: the columns of SCHEMA. paint and erase follow a path with a
    brush; polygon_add sets a new label, polygon_replace gives a label the
    polygon's shape; merge gives ``labels`` the one label ``label``, which is
    one of them; delete clears a label. A correction that changes nothing,
    that would overwrite another label, or whose label is absent, taken or in
    several parts is refused, and then all of its image's are: the image stays
    as it was. Verdicts are ``ok``, the reason, or ``not reached``.

    Each pixel goes through its image's corrections by itself: what a
    correction does to a pixel depends on its place and its label at that time
    alone. Only pixels that one of them covers, or whose label one names, are
    followed; what refuses is summed up over them.
    """
    kept = operations.selectExpr(*(f.split()[0] for f in SCHEMA.split(", ")))
    axis = lambda how, a: how(F.transform("points", lambda p: p[a]))
    boxed = kept.withColumns({"x0": axis(F.array_min, "x"), "x1": axis(F.array_max, "x"), "y0": axis(F.array_min, "y"), "y1": axis(F.array_max, "y")})
    boxed = written(boxed.withColumn("nth", F.row_number().over(W.partitionBy("image_id").orderBy("seq"))).where(F.col("nth") <= MOST + 1))
    session = boxed.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("nth", "seq", "op", "label", "labels", "points", "radius", "x0", "x1", "y0", "y1"))).alias("ops"))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    met = grid.select(*grids.PIXEL, F.col("label").cast("bigint").alias("label")).join(broadcast_if_small(session, 100_000), "image_id", "left")
    named = F.exists("ops", lambda o: (o["label"] == F.col("label")) | F.coalesce(F.array_contains(o["labels"], F.col("label")), F.lit(False)))
    live = F.coalesce(F.exists("ops", lambda o: _covered(o, x, y)) | ((F.col("label") > 0) & named), F.lit(False))

    def step(trace: Column, o: Column) -> Column:
        now = F.when(F.size(trace) == 0, F.col("label")).otherwise(F.element_at(trace, -1)["after"])
        on = _covered(o, x, y)
        return F.concat(trace, F.array(F.struct(o["nth"].alias("nth"), now.alias("now"), on.alias("on"), _after(o, now, on).alias("after"))))

    start = F.array().cast("array<struct<nth:int,now:bigint,on:boolean,after:bigint>>")
    followed = written(met.where(live).select(*grids.PIXEL, "label", F.aggregate("ops", start, step).alias("trace")))
    seen = followed.select("image_id", "y", "x", F.explode("trace").alias("t")).select("image_id", "y", "x", "t.*").join(boxed.select("image_id", "nth", "op", F.col("label").alias("_own"), "labels"), ["image_id", "nth"])
    own, now, on = F.col("_own"), F.col("now"), F.col("on")
    hit = F.count_if(on & F.when(F.col("op") == "polygon_add", now != 0).otherwise(~now.isin(0) & (now != own)))
    sums = seen.groupBy("image_id", "nth").agg(
        F.count_if(F.col("after") != now).alias("changed"), hit.alias("hit"), F.count_if(now == own).alias("present"), F.count_if(on & (now == own)).alias("overlap"),
        F.count_distinct(F.when(F.array_contains("labels", now), now)).alias("sources"),
    )
    parts = seen.where("op = 'polygon_replace' and now = _own").select((F.col("image_id") * (MOST + 2) + F.col("nth")).alias("image_id"), "y", "x")
    parts = grids.components(written(parts), width, height, diagonal=True).groupBy("image_id").agg(F.max("label").alias("parts")) if not parts.isEmpty() else None
    told = boxed.join(sums, ["image_id", "nth"], "left").fillna(0, ["changed", "hit", "present", "overlap", "sources"])
    told = told.join(parts.select(F.expr(f"image_id div {MOST + 2}").alias("image_id"), (F.col("image_id") % (MOST + 2)).cast("int").alias("nth"), "parts"), ["image_id", "nth"], "left") if parts is not None else told.withColumn("parts", F.lit(None).cast("bigint"))
    op = F.col("op")
    brush, drawn = op.isin("paint", "erase"), op.isin("paint", "erase", "polygon_add", "polygon_replace")
    bad_merge = (op == "merge") & ~F.coalesce((F.size("labels") >= 2) & (F.size(F.array_distinct("labels")) == F.size("labels")) & F.array_contains("labels", F.col("label")), F.lit(False))
    bad_points = drawn & ~F.coalesce((F.size("points") >= F.when(brush, 1).otherwise(3)) & (~brush | (F.col("radius") > 0)), F.lit(False))
    reason = (
        F.when(F.col("nth") > MOST, "too many").when(~F.coalesce(op.isin(*KINDS) & (F.col("label") >= 1), F.lit(False)) | bad_merge | bad_points, "invalid")
        .when((op == "polygon_add") & (F.col("present") > 0), "label in use").when(op.isin("polygon_replace", "delete") & (F.col("present") == 0), "absent").when((op == "merge") & (F.col("sources") < F.size("labels")), "absent")
        .when(F.col("parts") > 1, "several parts").when((op == "polygon_replace") & (F.col("overlap") == 0), "no overlap").when(drawn & (F.col("hit") > 0), "collision").when(F.col("changed") == 0, "no-op")
    )
    judged = written(told.withColumn("reason", reason))
    first = judged.where("reason is not null").groupBy("image_id").agg(F.min("nth").alias("stop"))
    verdict = F.when(F.col("nth") > F.col("stop"), "not reached").otherwise(F.coalesce("reason", F.lit("ok")))
    verdicts = judged.join(first, "image_id", "left").select("image_id", "seq", "op", F.when(verdict == "ok", F.col("changed")).otherwise(0).alias("changed"), verdict.alias("verdict"))
    moved = followed.join(first.select("image_id"), "image_id", "left_anti").select(*grids.PIXEL, F.element_at("trace", -1)["after"].alias("_new"))
    after = grid.join(moved, grids.PIXEL, "left")
    return after.withColumn("label", F.coalesce("_new", "label")).drop("_new"), verdicts
