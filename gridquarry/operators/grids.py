"""Measurements on label grids: pixels as rows, labels as grouping keys.

Label 0 is background and is measured nowhere. Ratios with a zero denominator
are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.sources.workspace import shuffled

from .components import grid_components
from .matching import best_matching

PIXEL = ["image_id", "y", "x"]
OBJECT = ["image_id", "label"]


def r(c: Column, digits: int = 6) -> Column:
    """Rounded, so that the order of a sum doesn't show."""
    return F.round(c, digits)


def object_measures(grid: DataFrame, channels: list[str], width: int, height: int) -> DataFrame:
    """Per object: pixels, centroid, bounding box, border flag, and of each
    channel mean, sum, least, greatest and population deviation."""
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)
    stats = [s for c in channels for s in (r(F.avg(c)).alias(f"{c}_mean"), r(F.sum(c), 4).alias(f"{c}_sum"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), r(F.stddev_pop(c)).alias(f"{c}_sd"))]
    return grid.where("label > 0").groupBy(*OBJECT).agg(
        F.count("*").alias("pixels"),
        r(F.avg("y")).alias("centroid_y"),
        r(F.avg("x")).alias("centroid_x"),
        F.min("y").alias("y0"),
        F.min("x").alias("x0"),
        (F.max("y") + 1).alias("y1"),
        (F.max("x") + 1).alias("x1"),
        F.bool_or(edge).alias("border"),
        *stats,
    )


def principal_radii(grid: DataFrame) -> DataFrame:
    """Roots of the eigenvalues of the covariance of an object's coordinates,
    the larger one first."""
    m = grid.where("label > 0").groupBy(*OBJECT).agg(F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"))
    half = (F.col("a") + F.col("b")) / 2
    root = F.sqrt(((F.col("a") - F.col("b")) / 2) ** 2 + F.col("c") ** 2)
    return m.select(*OBJECT, r(F.sqrt(F.greatest(half + root, F.lit(0.0)))).alias("major"), r(F.sqrt(F.greatest(half - root, F.lit(0.0))), 5).alias("minor"))


def tiled_measures(grid: DataFrame, channel: str, tile: int, other: str | None = None) -> DataFrame:
    """Mean and population deviation of each object (and the covariance of two
    channels) from those of its tiles: to the tiles' own squared deviations
    come those of their means from the object's."""
    at = [F.expr(f"y div {tile}").alias("ty"), F.expr(f"x div {tile}").alias("tx")]
    second = other or channel
    parts = grid.where("label > 0").groupBy(*OBJECT, *at).agg(F.count("*").alias("n"), F.avg(channel).alias("a"), F.avg(second).alias("b"), (F.covar_pop(channel, channel) * F.count("*")).alias("aa"), (F.covar_pop(channel, second) * F.count("*")).alias("ab"))
    w = W.partitionBy(*OBJECT)
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(w) / F.sum("n").over(w)
    off = parts.withColumns({"mean": mean("a"), "second": mean("b")})
    more = lambda c, d: F.col("n") * (F.col("a") - F.col("mean")) * (F.col(c) - F.col(d))
    n = F.sum("n")
    spread = F.sqrt(F.greatest(F.sum(F.col("aa") + more("a", "mean")), F.lit(0.0)) / n)
    covariance = [r(F.sum(F.col("ab") + more("b", "second")) / n, 8).alias("covariance")] if other else []
    return off.groupBy(*OBJECT).agg(n.alias("pixels"), r(F.first("mean")).alias("mean"), r(spread, 5).alias("sd"), *covariance)


def compartments(grid: DataFrame, inner: str, channel: str) -> DataFrame:
    """Of each object: pixels, sum, mean, least, greatest and population
    deviation of a channel over all of it, inside another grid's objects (nuclear) and outside them."""
    n, c = F.col(inner) > 0, F.col(channel)
    parts = []
    for name, inside in (("cell", F.lit(True)), ("nuclear", n), ("cytoplasm", ~n)):
        v = F.when(inside, c)
        parts += [F.count(v).alias(f"{name}_pixels"), r(F.coalesce(F.sum(v), F.lit(0.0)), 4).alias(f"{name}_sum"), r(F.avg(v)).alias(f"{name}_mean"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"), r(F.stddev_pop(v), 5).alias(f"{name}_sd")]
    return grid.where("label > 0").groupBy(*OBJECT).agg(*parts)


def overlaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """Common pixels and areas of each pair of objects of two grids, with
    their intersection over union: one shuffle on the pixel, one on the pair."""
    a = first.select(*PIXEL, F.col("label").alias("ref"))
    b = second.select(*PIXEL, F.col("label").alias("pred"))
    pairs = a.join(b, PIXEL).groupBy("image_id", "ref", "pred").agg(F.count("*").alias("both"))
    whole = lambda key: F.sum("both").over(W.partitionBy("image_id", key))
    counted = pairs.withColumns({"ref_area": whole("ref"), "pred_area": whole("pred")}).where("ref > 0 and pred > 0")
    return counted.withColumn("iou", F.col("both") / (F.col("ref_area") + F.col("pred_area") - F.col("both")))


def associate(nuclei: DataFrame, cells: DataFrame) -> DataFrame:
    """Each nucleus with the cell that covers most of it (of equal ones the
    lowest id; null outside all), the share, and whether others cover it too."""
    a = nuclei.where("label > 0").select(*PIXEL, F.col("label").alias("nucleus"))
    b = cells.select(*PIXEL, F.when(F.col("label") > 0, F.col("label")).alias("cell"))
    counts = a.join(b, PIXEL).groupBy("image_id", "nucleus", "cell").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("cell").isNotNull(), F.struct("n", (-F.col("cell")).alias("neg"))))
    return counts.groupBy("image_id", "nucleus").agg(best.alias("best"), F.sum("n").alias("pixels"), F.sum(F.when(F.col("cell").isNull(), F.col("n"))).alias("out"), F.count("cell").alias("cells")).select(
        "image_id", "nucleus", (-F.col("best.neg")).alias("cell"), r(F.coalesce(F.col("best.n"), F.lit(0)) / F.col("pixels")).alias("share"), r(F.coalesce("out", F.lit(0)) / F.col("pixels")).alias("outside"), (F.col("cells") > 1).alias("ambiguous")
    )


def association_rollup(associated: DataFrame) -> DataFrame:
    """Of each cell: its nuclei in order, their number and the ambiguous ones;
    nuclei without a cell stay together under a null cell."""
    return associated.groupBy("image_id", "cell").agg(F.array_join(F.sort_array(F.collect_list("nucleus")).cast("array<string>"), ",").alias("nuclei"), F.count("*").alias("n"), F.count_if("ambiguous").alias("ambiguous"))


def region_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per image: foreground pixels of two grids, common and joint ones, and
    their intersection over union and Dice score, null without foreground."""
    both = first.select(*PIXEL, (F.col("label") > 0).alias("a")).join(second.select(*PIXEL, (F.col("label") > 0).alias("b")), PIXEL)
    c = both.groupBy("image_id").agg(F.count_if("a").alias("reference"), F.count_if("b").alias("prediction"), F.count_if(F.col("a") & F.col("b")).alias("common"), F.count_if(F.col("a") | F.col("b")).alias("joint"))
    return c.withColumns({"iou": r(F.try_divide("common", "joint")), "dice": r(F.try_divide(2 * F.col("common"), F.col("reference") + F.col("prediction")))})


def matches(first: DataFrame, second: DataFrame, threshold: float) -> DataFrame:
    """image_id, ref, pred, iou of the matching with most pairs of at least
    ``threshold`` and, among those, the greatest sum."""
    pairs = overlaps(first, second).where(F.col("iou") >= threshold).select("image_id", "ref", "pred", "iou")
    if threshold > 0.5:  # no object can have two partners
        return pairs
    return best_matching(pairs.withColumn("loss", 1 - F.col("iou")), ["image_id"], "ref", "pred", "loss").drop("loss")


def instance_agreement(first: DataFrame, second: DataFrame, threshold: float) -> DataFrame:
    """Per image: matched pairs, missed and surplus objects, precision, recall,
    F1 and mean IoU of the matches (null where undefined), errors of the count,
    objects split among several or merged in one (any overlap), and the ids
    left unmatched."""
    met = overlaps(first, second).select("image_id", "ref", "pred")
    pairs = matches(first, second, threshold)
    refs = first.where("label > 0").select("image_id", F.col("label").alias("ref")).distinct()
    preds = second.where("label > 0").select("image_id", F.col("label").alias("pred")).distinct()
    several = lambda key, name: met.groupBy("image_id", key).count().where("count > 1").groupBy("image_id").agg(F.count("*").alias(name))
    left = lambda every, key, name: every.join(pairs, ["image_id", key], "left_anti").groupBy("image_id").agg(F.array_join(F.sort_array(F.collect_list(key)).cast("array<string>"), ",").alias(name))
    t = first.select("image_id").union(second.select("image_id")).distinct()
    for part in (
        refs.groupBy("image_id").agg(F.count("*").alias("refs")),
        preds.groupBy("image_id").agg(F.count("*").alias("preds")),
        pairs.groupBy("image_id").agg(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou")),
        several("ref", "splits"),
        several("pred", "merges"),
        left(refs, "ref", "missed"),
        left(preds, "pred", "surplus"),
    ):
        t = t.join(part, "image_id", "left")
    t = t.fillna(0, ["tp", "refs", "preds", "splits", "merges"]).fillna("", ["missed", "surplus"])
    error = F.col("preds") - F.col("refs")
    return t.select(
        "image_id", "tp", (F.col("preds") - F.col("tp")).alias("fp"), (F.col("refs") - F.col("tp")).alias("fn"), r(F.try_divide("tp", "preds")).alias("precision"), r(F.try_divide("tp", "refs")).alias("recall"), r(F.try_divide(2 * F.col("tp"), F.col("refs") + F.col("preds"))).alias("f1"), r(F.col("mean_iou")).alias("mean_iou"),
        error.alias("count_error"), r(F.try_divide(F.abs(error), F.col("refs"))).alias("count_error_share"), "splits", "merges", "missed", "surplus",
    )


def colocalisation(grid: DataFrame, first: str, second: str, at_first: float, at_second: float) -> DataFrame:
    """Per image: correlation of two channels and the shares of each that lie
    where both are above their thresholds."""
    a, b = F.col(first), F.col(second)
    both = (a > at_first) & (b > at_second)
    share = lambda v, at: F.try_divide(F.sum(F.when(both, v)), F.sum(F.when(v > at, v)))
    return grid.groupBy("image_id").agg(r(F.corr(first, second), 5).alias("pearson"), r(share(a, at_first)).alias("first_share"), r(share(b, at_second)).alias("second_share"))


def size_and_border(grid: DataFrame, least: int, width: int, height: int) -> DataFrame:
    """The grid without objects of fewer than ``least`` pixels or at the
    image's border; others are numbered anew from 1 in order of their ids."""
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)
    kept = grid.where("label > 0").groupBy(*OBJECT).agg(F.count("*").alias("n"), F.bool_or(edge).alias("edge")).where((F.col("n") >= least) & ~F.col("edge"))
    numbered = kept.select(*OBJECT, F.row_number().over(W.partitionBy("image_id").orderBy("label")).cast("bigint").alias("new"))
    return grid.join(numbered, OBJECT, "left").select(*PIXEL, F.coalesce("new", F.lit(0)).alias("label"))


def compact_labels(grid: DataFrame) -> DataFrame:
    """Labels renumbered from 1 in order of their ids; background stays 0."""
    known = grid.where("label > 0").select(*OBJECT).distinct()
    numbered = known.select(*OBJECT, F.row_number().over(W.partitionBy("image_id").orderBy("label")).cast("bigint").alias("new"))
    return grid.join(numbered, OBJECT, "left").select(*PIXEL, F.coalesce("new", F.lit(0)).alias("label"))


def neighbours(grid: DataFrame, columns: list[str], diagonal: bool = False, ahead: bool = False) -> DataFrame:
    """Each pixel with each neighbour's columns, prefixed n_. The pixels are
    shifted and joined on the coordinate: an equi-join, whatever the image."""
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    if not ahead:
        steps += [(-a, -b) for a, b in steps]
    moved = grid.select("image_id", F.explode(F.array(*(F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x"), F.lit(-a).alias("dy"), F.lit(-b).alias("dx")) for a, b in steps))).alias("at"), *(F.col(c).alias(f"n_{c}") for c in columns))
    return grid.join(shuffled(moved.select("image_id", "at.*", *(f"n_{c}" for c in columns))), PIXEL)


def components(mask: DataFrame, width: int, height: int, value: str | None = None, diagonal: bool = False, tile: int = 64) -> DataFrame:
    """Connected components of the pixels of a mask (only neighbours of equal
    ``value`` connect, if given): the pixels with label, numbered from 1 in
    order of each component's first pixel by rows. Tiles of ``tile`` pixels a
    side are labelled by themselves and then joined along their seams."""
    number = (F.col("image_id") * height + F.col("y")) * width + F.col("x")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    placed = grid_components(mask.withColumn("node", number), ["y", "x"], steps, tile, ["image_id"], value)
    # The root is the least pixel number: the first pixel by rows.
    firsts = placed.select("image_id", "root").distinct().withColumn("label", F.row_number().over(W.partitionBy("image_id").orderBy("root")).cast("bigint"))
    return placed.join(firsts, ["image_id", "root"]).select(*PIXEL, "label")


def morphometrics(grid: DataFrame) -> DataFrame:
    """Per object: pixels, exposed edges, circularity, the eigenvalues of the
    covariance of its pixels' places, eccentricity, elongation, and why ratios
    are null (one pixel, pixels on a line). An edge counts where the neighbour
    has another label or none. Whether pixels lie on a line is decided in whole
    numbers."""
    own = grid.where("label > 0").select(*PIXEL, "label")
    same = neighbours(own, ["label"]).where("label = n_label").groupBy(*OBJECT).agg(F.count("*").alias("inner"))
    big = lambda c: F.sum(c).cast("decimal(38,0)")
    y, x = F.col("y").cast("bigint"), F.col("x").cast("bigint")
    sums = own.groupBy(*OBJECT).agg(F.count("*").alias("pixels"), big(y).alias("y"), big(x).alias("x"), big(y * y).alias("yy"), big(x * x).alias("xx"), big(x * y).alias("xy"))
    n = F.col("pixels").cast("decimal(12,0)")
    moment = lambda pair, a, b: (n * F.col(pair) - F.col(a) * F.col(b)).cast("decimal(18,0)")
    e = sums.join(same, OBJECT, "left").select(*OBJECT, "pixels", (4 * F.col("pixels") - F.coalesce("inner", F.lit(0))).alias("edges"), moment("xx", "x", "x").alias("a"), moment("yy", "y", "y").alias("b"), moment("xy", "x", "y").alias("c"))
    line = F.col("a") * F.col("b") == F.col("c") * F.col("c")
    a, b, c = (F.col(k).cast("double") / F.col("pixels") ** 2 for k in "abc")
    root = F.sqrt(((a - b) / 2) ** 2 + c**2)
    e = e.withColumns({"major": (a + b) / 2 + root, "minor": F.when(line, 0.0).otherwise(F.greatest((a + b) / 2 - root, F.lit(0.0)))})
    single = F.col("pixels") == 1
    return e.select(
        *OBJECT, "pixels", "edges", r(F.when(~single, F.least(4 * F.pi() * F.col("pixels") / F.col("edges") ** 2, F.lit(1.0)))).alias("circularity"), r(F.col("major")).alias("major"), r(F.col("minor")).alias("minor"),
        r(F.when(~single, F.sqrt(F.greatest(1 - F.col("minor") / F.col("major"), F.lit(0.0))))).alias("eccentricity"), r(F.when(~line, F.sqrt(F.col("major")) / F.sqrt(F.col("minor"))), 5).alias("elongation"),
        F.when(single, "one pixel").when(line, "pixels on a line").otherwise("").alias("reason"),
    )


def rings(grid: DataFrame, radius: int, channel: str) -> DataFrame:
    """Of each nucleus: pixels and mean of a channel over its ring, background
    within ``radius`` of it and of no other nucleus."""
    steps = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if 0 < a * a + b * b <= radius * radius]
    border = neighbours(grid.select(*PIXEL, "label"), ["label"]).where("label > 0 and label <> n_label").select(*PIXEL, "label").distinct()
    around = border.select("image_id", "label", F.explode(F.array(*(F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x")) for a, b in steps))).alias("at")).select("image_id", "at.*", F.col("label").alias("nucleus"))
    claims = around.groupBy(*PIXEL).agg(F.min("nucleus").alias("nucleus"), F.max("nucleus").alias("other")).where("nucleus = other").drop("other")
    ring = grid.where("label = 0").join(shuffled(claims), PIXEL)
    return ring.groupBy("image_id", "nucleus").agg(F.count("*").alias("pixels"), r(F.avg(channel)).alias("mean"))


def otsu(grid: DataFrame, channel: str, bins: int = 256) -> DataFrame:
    """Per image, the threshold of greatest variance between classes over a
    histogram of equal bins: the upper edge of the lower class's last bin."""
    ends = grid.groupBy("image_id").agg(F.min(channel).alias("low"), F.max(channel).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.least(F.floor((F.col(channel) - F.col("low")) / width), F.lit(bins - 1))
    counts = grid.join(ends, "image_id").where("high > low").groupBy("image_id", "low", "high", at.alias("bin")).agg(F.count("*").alias("n"))
    centre = F.col("bin") + 0.5
    before = W.partitionBy("image_id").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy("image_id")
    sums = counts.select("image_id", "low", "high", "bin", F.sum("n").over(before).alias("w"), F.sum(F.col("n") * centre).over(before).alias("m"), F.sum("n").over(every).alias("total"), F.sum(F.col("n") * centre).over(every).alias("all"))
    spread = F.when(F.col("w") < F.col("total"), (F.col("m") * F.col("total") - F.col("all") * F.col("w")) ** 2 / (F.col("w") * (F.col("total") - F.col("w"))))
    best = sums.withColumn("spread", r(spread, 3)).where("spread is not null").groupBy("image_id", "low", "high").agg(F.max(F.struct("spread", (-F.col("bin")).alias("neg"))).alias("s"))
    return best.select("image_id", r(F.col("low") + (1 - F.col("s.neg")) * width).alias("threshold"))


def normalized(grid: DataFrame, channel: str) -> DataFrame:
    """The channel between its 1st and 99th percentile in each image, clipped
    to 0..1; between its ends where those percentiles are equal. Values that
    aren't finite count as the median of the others."""
    v = F.col(channel).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    ends = grid.groupBy("image_id").agg(F.percentile(finite, F.array(F.lit(0.01), F.lit(0.99), F.lit(0.5))).alias("p"), F.min(finite).alias("least"), F.max(finite).alias("most"))
    low = F.when(F.col("p")[0] < F.col("p")[1], F.col("p")[0]).otherwise(F.col("least"))
    high = F.when(F.col("p")[0] < F.col("p")[1], F.col("p")[1]).otherwise(F.col("most"))
    scaled = F.greatest(F.least(F.try_divide(F.coalesce(finite, F.col("p")[2]) - low, high - low), F.lit(1.0)), F.lit(0.0))
    return grid.join(ends, "image_id").select(*PIXEL, r(F.coalesce(scaled, F.lit(0.0))).alias("value"))


def centroid_offsets(grid: DataFrame, scale: float) -> DataFrame:
    """Per foreground pixel, the clipped offsets to its object's centroid."""
    centre = grid.where("label > 0").groupBy(*OBJECT).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    clip = lambda c: r(F.greatest(F.least(c / scale, F.lit(1.0)), F.lit(-1.0))) + 0.0
    return grid.where("label > 0").join(centre, OBJECT).select(*PIXEL, clip(F.col("cy") - F.col("y")).alias("dy"), clip(F.col("cx") - F.col("x")).alias("dx"))


def located(grid: DataFrame) -> DataFrame:
    """Of each object the pixel of its own that lies nearest to its centroid,
    of equal ones the first by rows."""
    centre = grid.where("label > 0").groupBy(*OBJECT).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    far = r((F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2)
    best = grid.where("label > 0").join(centre, OBJECT).groupBy(*OBJECT).agg(F.min(F.struct(far.alias("far"), "y", "x")).alias("b"))
    return best.select(*OBJECT, "b.y", "b.x")


def label_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per image: changed pixels, and the ids that were added, removed, or
    retained with other pixels."""
    both = before.select(*PIXEL, F.col("label").alias("a")).join(after.select(*PIXEL, F.col("label").alias("b")), PIXEL, "full_outer").fillna(0, ["a", "b"])
    counts = both.groupBy("image_id").agg(F.count_if(F.col("a") != F.col("b")).alias("changed"))
    end = lambda label, first: F.struct(F.col(label).alias("label"), F.lit(first).alias("before"), F.lit(not first).alias("after"), (F.col("a") != F.col("b")).alias("touched"))
    ids = both.select("image_id", F.inline(F.array(end("a", True), end("b", False)))).where("label > 0").groupBy("image_id", "label").agg(F.bool_or("before").alias("before"), F.bool_or("after").alias("after"), F.bool_or("touched").alias("touched"))
    listed = lambda rule, name: F.array_join(F.sort_array(F.collect_list(F.when(F.expr(rule), F.col("label")))).cast("array<string>"), ",").alias(name)
    sets = ids.groupBy("image_id").agg(listed("after and not before", "added"), listed("before and not after", "removed"), listed("before and after and touched", "retained"))
    return counts.join(sets, "image_id", "left").fillna("", ["added", "removed", "retained"])


def field_assay(grid: DataFrame, channel: str, *, saturated: float, above: float, background: float | None = None) -> DataFrame:
    """Per image: the signed integral of a channel over the nuclei less the
    background (given, or the median outside them), nuclei, the integral a
    nucleus, the share of nuclei whose mean exceeds the background by more than
    ``above``, and saturated pixels."""
    v = F.col(channel)
    if background is None:
        grid = grid.join(grid.where("label = 0").groupBy("image_id").agg(F.median(channel).alias("bg")), "image_id")
    else:
        grid = grid.withColumn("bg", F.lit(background))
    nuclei = grid.where("label > 0").groupBy("image_id", "label").agg(F.avg(v).alias("mean"), F.first("bg").alias("bg"), F.sum(v - F.col("bg")).alias("sum")).groupBy("image_id").agg(F.sum("sum").alias("integral"), F.count("*").alias("nuclei"), F.avg((F.col("mean") - F.col("bg") > above).cast("double")).alias("positive"))
    pixels = grid.groupBy("image_id").agg(F.count_if(v >= saturated).alias("saturated"))
    return pixels.join(nuclei, "image_id", "left").select("image_id", r(F.col("integral"), 4).alias("integral"), F.coalesce("nuclei", F.lit(0)).alias("nuclei"), r(F.try_divide("integral", "nuclei"), 5).alias("per_nucleus"), r(F.col("positive")).alias("positive_fraction"), "saturated")


def alignment(grid: DataFrame, channel: str, dy: int, dx: int, whole: int, *, least_overlap: float, least_correlation: float) -> DataFrame:
    """Per image: pixels that overlap after a shift, their share of ``whole``,
    their correlation (null where a side is constant), and whether both reach
    what is asked."""
    a = grid.select(*PIXEL, F.col(channel).alias("v"))
    b = a.select("image_id", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("v").alias("w"))
    varied = (F.max("v") > F.min("v")) & (F.max("w") > F.min("w"))
    q = a.join(b, PIXEL).groupBy("image_id").agg(F.count("*").alias("overlap"), r(F.count("*") / whole).alias("fraction"), r(F.when(varied, F.corr("v", "w")), 5).alias("correlation"))
    return q.withColumn("accepted", F.coalesce((F.col("fraction") >= least_overlap) & (F.col("correlation") >= least_correlation), F.lit(False)))
