"""Study summaries: objects to images to replicates to conditions.

Every level is an average of the one below with equal weights; numbers of
objects never act as sample size. Missing replicates are left out and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def single_contract(rows: DataFrame, by: str, fields: dict[str, str]) -> DataFrame:
    """by, the distinct values of each field, and whether none has several."""
    n = {name: F.count_distinct(c) for name, c in fields.items()}
    whole = F.lit(True)
    for c in n.values():
        whole = whole & (c <= 1)
    return rows.groupBy(by).agg(*(c.alias(name) for name, c in n.items()), whole.alias("single"))


def stem_pairs(labels: DataFrame, sources: DataFrame) -> DataFrame:
    """``labels`` (name and others) with verdict: paired with the one source of
    the same name but for its case and ending, or with none or several."""
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    n = sources.groupBy(stem.alias("_stem")).agg(F.count("*").alias("_n"))
    verdict = F.when(F.col("_n").isNull(), "none").when(F.col("_n") > 1, "several").otherwise("paired")
    return labels.withColumn("_stem", stem).join(n, "_stem", "left").withColumn("verdict", verdict).drop("_stem", "_n")


def chain_verdicts(events: DataFrame, chain: str, place: str, content: str, previous: str) -> DataFrame:
    """chain, place, verdict of each place of a chain whose events keep the
    hash of the content before them: ok, broken, or duplicate."""
    once = events.groupBy(chain, place).agg(F.count("*").alias("_n"), F.min(content).alias("_c"), F.min(previous).alias("_p"))
    before = F.sha2(F.coalesce(F.lag("_c").over(W.partitionBy(chain).orderBy(place)), F.lit("")), 256)
    verdict = F.when(F.col("_n") > 1, "duplicate").when(F.col("_p") != F.col("_b"), "broken").otherwise("ok")
    return once.withColumn("_b", before).select(chain, place, verdict.alias("verdict"))


def report_verdict(name: str, saved: DataFrame, again: DataFrame) -> DataFrame:
    """report, verdict, differences: rows that a saved report and the one
    computed again don't share, from either side."""
    n = saved.exceptAll(again).union(again.exceptAll(saved)).agg(F.count("*").alias("differences"))
    return n.select(F.lit(name).alias("report"), F.when(F.col("differences") == 0, "same").otherwise("changed").alias("verdict"), "differences")


def extended_medians(groups: DataFrame, values: DataFrame, by: str, value: str) -> DataFrame:
    """by, kind, median: a missing value counts as infinite; the median is
    finite, infinite, or none without any row."""
    m = values.groupBy(by).agg(F.median(F.coalesce(F.col(value), F.lit(float("inf")))).alias("m"))
    kind = F.when(F.col("m").isNull(), "none").when(F.col("m") == float("inf"), "infinite").otherwise("finite")
    return groups.join(m, by, "left").select(by, kind.alias("kind"), F.round(F.when(F.col("m") < float("inf"), F.col("m")), 6).alias("median"))


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def image_means(obs: DataFrame, value: str = "value") -> DataFrame:
    """One row an image: objects and mean value with the image's metadata."""
    return obs.groupBy("image_id", "review", "condition", "replicate").agg(F.count(value).alias("objects"), F.avg(value).alias("mean"))


def replicate_means(images: DataFrame) -> DataFrame:
    """One row a replicate of a condition: reviewed images and their mean."""
    return images.where("review <> 'excluded' and replicate is not null and mean is not null").groupBy("condition", "replicate").agg(F.count("*").alias("images"), F.sum("objects").alias("objects"), F.avg("mean").alias("mean"))


def condition_summary(obs: DataFrame, value: str = "value") -> DataFrame:
    """One row a condition, also those without a replicate: replicates, images,
    objects, mean of the replicates' means and their sample deviation."""
    images = image_means(obs, value)
    found = replicate_means(images).groupBy("condition").agg(F.count("*").alias("replicates"), F.sum("images").alias("images"), F.sum("objects").alias("objects"), r(F.avg("mean")).alias("mean"), r(F.stddev_samp("mean"), 5).alias("sd"))
    return images.select("condition").distinct().join(found, "condition", "left").fillna(0, ["replicates", "images", "objects"])


def inclusion(images: DataFrame) -> DataFrame:
    """Why an image counts or doesn't."""
    reason = F.when(F.col("review") == "excluded", "excluded-by-review").when(F.col("mean").isNull(), "no-valid-object-means").when(F.col("replicate").isNull(), "missing-biological-replicate").otherwise("included")
    return images.withColumn("reason", reason)


def band(c: Column, edges: list[float]) -> Column:
    """Number of the half-open band [edge, next) that holds a value, from 0;
    null outside all."""
    inside = (c >= edges[0]) & (c < edges[-1])
    return F.when(inside, sum((F.when(c >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0)))


def donor_density(fields: DataFrame, bands: int) -> DataFrame:
    """Per condition and band: donors with a density, their mean, deviation
    and median. A donor's counts and areas are pooled before they are divided;
    a zero area has no density. ``fields``: condition, donor, band, n, area."""
    pooled = fields.groupBy("condition", "donor", "band").agg(F.sum("n").alias("n"), F.sum("area").alias("area"))
    density = pooled.withColumn("density", F.try_divide("n", "area"))
    scaffold = fields.select("condition").distinct().select("condition", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    found = density.groupBy("condition", "band").agg(F.count("density").alias("donors"), r(F.avg("density")).alias("mean"), r(F.stddev_samp("density"), 5).alias("sd"), r(F.median("density")).alias("median"))
    return scaffold.join(found, ["condition", "band"], "left").fillna(0, ["donors"])


def matched_pairs(means: DataFrame, left: str, right: str) -> DataFrame:
    """Donors of both conditions: right less left."""
    a = means.where(F.col("condition") == left).select("donor", F.col("mean").alias("left"))
    b = means.where(F.col("condition") == right).select("donor", F.col("mean").alias("right"))
    return a.join(b, "donor").select("donor", r(F.col("right") - F.col("left")).alias("difference"))


def unmatched(means: DataFrame, left: str, right: str) -> DataFrame:
    """Donors of one of two conditions alone, with that condition."""
    two = means.where(F.col("condition").isin(left, right))
    return two.groupBy("donor").agg(F.count_distinct("condition").alias("n"), F.min("condition").alias("condition")).where("n = 1").select("donor", "condition")


def compare_summaries(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Full outer join of two summaries (key, mean) and their difference,
    null where one lacks."""
    a, b = first.select(key, F.col("mean").alias("left")), second.select(key, F.col("mean").alias("right"))
    return a.join(b, key, "full_outer").select(key, r(F.col("left")).alias("left"), r(F.col("right")).alias("right"), r(F.col("right") - F.col("left")).alias("difference"))


def outliers(images: DataFrame, group: str, value: str, limit: float = 3.5, least: int = 8) -> DataFrame:
    """Images whose modified z-score, 0.6745 * |value - median| / MAD, is above
    ``limit``; groups of fewer than ``least`` or without spread have none."""
    middle = images.groupBy(group).agg(F.median(value).alias("middle"), F.count(value).alias("n"))
    off = images.join(middle, group).where(F.col("n") >= least).withColumn("off", F.abs(F.col(value) - F.col("middle")))
    spread = off.groupBy(group).agg(F.median("off").alias("mad"))
    return off.join(spread, group).where("mad > 0").where(0.6745 * F.col("off") > limit * F.col("mad"))


def quality_flags(images: DataFrame) -> DataFrame:
    """Flags of an image's coverage (percent) and of the share of its largest
    object (percent); status error, warning or ok."""
    c, big = F.col("coverage"), F.col("largest")
    flags = F.array_compact(F.array(F.when(F.col("objects") == 0, "no_instances"), F.when(c >= 80, "coverage_error").when(c >= 60, "coverage_warning").when(c <= 0.05, "coverage_low"), F.when(big >= 50, "largest_error").when(big >= 20, "largest_warning")))
    bad = F.exists("flags", lambda f: f.endswith("_error") | (f == "no_instances"))
    return images.withColumn("flags", flags).withColumn("status", F.when(bad, "error").when(F.size("flags") > 0, "warning").otherwise("ok"))


def z_prime(wells: DataFrame, negative: str, positive: str) -> DataFrame:
    """1 - 3 (sd + sd) / |difference of means| of two groups of wells; null
    with fewer than two of either or equal means."""
    n, p = (F.when(F.col("control") == c, F.col("value")) for c in (negative, positive))
    s = wells.agg(F.avg(n).alias("a"), F.stddev_samp(n).alias("sa"), F.avg(p).alias("b"), F.stddev_samp(p).alias("sb"))
    return s.select(r(1 - F.try_divide(3 * (F.col("sa") + F.col("sb")), F.abs(F.col("a") - F.col("b")))).alias("z_prime"))


def gates(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Long metrics (metric, value) against named limits: evaluated, passed."""
    at, op = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, (sign, limit) in limits.items():
        at, op = F.when(F.col("metric") == name, limit).otherwise(at), F.when(F.col("metric") == name, sign).otherwise(op)
    known = metrics.withColumns({"limit": at, "sign": op})
    return known.select("metric", F.col("limit").isNotNull().alias("evaluated"), F.when(F.col("sign") == "<=", F.col("value") <= F.col("limit")).when(F.col("sign") == ">=", F.col("value") >= F.col("limit")).alias("passed"))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")
