"""Queries on a population of objects: filters, order, pages, summaries.

Null and non-finite metrics are missing: they pass no range filter, sort last
in both directions and are counted, never taken as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.sources.workspace import broadcast_if_small, with_index, written


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def in_ranges(ranges: dict[str, tuple[float | None, float | None]]) -> Column:
    """Whether all metrics lie in their inclusive ranges; missing ones don't."""
    out = F.lit(True)
    for metric, (low, high) in ranges.items():
        v = finite(F.col(metric))
        out = out & v.isNotNull()
        if low is not None:
            out = out & (v >= low)
        if high is not None:
            out = out & (v <= high)
    return F.coalesce(out, F.lit(False))


def range_filters(df: DataFrame, ranges: dict) -> DataFrame:
    """The rows inside all ranges."""
    return df.where(in_ranges(ranges))


def filter_accounting(df: DataFrame, ranges: dict) -> DataFrame:
    """One row: total, selected, and the rows missing each metric."""
    return df.agg(F.count("*").alias("total"), F.count_if(in_ranges(ranges)).alias("selected"), *(F.count_if(finite(F.col(m)).isNull()).alias(f"missing_{m}") for m in ranges))


def ordering(metric: str, descending: bool = False, tie: str = "label") -> list[Column]:
    v = finite(F.col(metric).cast("double"))
    return [v.desc_nulls_last() if descending else v.asc_nulls_last(), F.col(tie).asc()]


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def summary(df: DataFrame, metric: str, *by: str) -> DataFrame:
    """n, missing, least, greatest, mean and exact median of a metric."""
    v = finite(F.col(metric))
    one = df.groupBy(*by).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.round(F.avg(v), 6).alias("mean"))
    middle = quantiles(df, metric, [0.5], *by).select(*(F.col(c).alias(f"_{c}") for c in by), F.round("q0", 6).alias("median"))
    same = F.lit(True)
    for c in by:
        same = same & one[c].eqNullSafe(F.col(f"_{c}"))
    return one.join(middle, same, "left").select(*by, "n", "missing", "least", "greatest", "mean", "median")


def quantiles(df: DataFrame, metric: str, shares: list[float], *by: str) -> DataFrame:
    """by, q0, q1 and so on: exact quantiles of the finite values of a metric,
    between neighbours in proportion. Values are range-sorted over the cluster
    and picked by their places, so no group is gathered anywhere."""
    values = df.select(*by, finite(F.col(metric)).cast("double").alias("_v")).where("_v is not null")
    placed = with_index(values, *by, "_v", name="_i")
    ends = placed.groupBy(*by).agg(F.min("_i").alias("_first"), (F.count("*") - 1).alias("_last"))
    picks = []
    for k, share in enumerate(shares):
        at = F.lit(share) * F.col("_last")
        low = F.floor(at)
        for place, weight in ((low, 1 - (at - low)), (F.least(low + 1, F.col("_last")), at - low)):
            picks.append(F.struct(F.lit(k).alias("k"), (F.col("_first") + place).alias("at"), weight.alias("w")))
    wanted = broadcast_if_small(ends.select(*by, F.inline(F.array(*picks))))
    found = wanted.join(placed.select("_i", "_v"), wanted["at"] == F.col("_i"))
    return found.groupBy(*by).agg(*(F.sum(F.when(F.col("k") == k, F.col("w") * F.col("_v"))).alias(f"q{k}") for k in range(len(shares))))


def histogram(df: DataFrame, metric: str, bins: int) -> DataFrame:
    """bin, low, high, n: equal bins from the least to the greatest value, left
    closed, the last one closed; a single value has one bin. Empty bins stay."""
    v = finite(F.col(metric)).cast("double")
    values = df.select(v.alias("v")).where("v is not null")
    ends = values.agg(F.min("v").alias("least"), F.max("v").alias("greatest"))
    # One row of two numbers: its size is fixed.
    n = F.when(F.col("least") == F.col("greatest"), 1).otherwise(bins)
    ends = ends.where("least is not null").withColumn("bins", n)
    at = F.when(F.col("least") == F.col("greatest"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("least")) * F.col("bins") / (F.col("greatest") - F.col("least"))), F.col("bins") - 1))
    counted = values.join(F.broadcast(ends)).select(at.cast("int").alias("bin")).groupBy("bin").count()
    edge = lambda i: F.col("least") + (F.col("greatest") - F.col("least")) * i / F.col("bins")
    all_bins = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    return all_bins.join(counted, "bin", "left").select("bin", F.round(edge(F.col("bin")), 6).alias("low"), F.round(edge(F.col("bin") + 1), 6).alias("high"), F.coalesce("count", F.lit(0)).alias("n"))


def missing_counts(df: DataFrame, *metrics: str) -> DataFrame:
    """metric, missing: rows without each metric."""
    one = df.agg(*(F.count_if(finite(F.col(m).cast("double")).isNull()).alias(m) for m in metrics))
    return one.unpivot([], list(metrics), "metric", "missing")


def selected_rank(df: DataFrame, order_metric: str, label: int, descending: bool = False) -> DataFrame:
    """Place, from 0, of one label in the population's order: the number of
    rows before it. No row when the label isn't there."""
    v = finite(F.col(order_metric).cast("double"))
    own = df.where(F.col("label") == label).select(v.alias("at"), F.col("label").alias("own")).limit(1)
    earlier = (v > F.col("at")) if descending else (v < F.col("at"))
    before = F.when(v.isNull(), F.col("at").isNull() & (F.col("label") < F.col("own"))).otherwise(F.col("at").isNull() | earlier | ((v == F.col("at")) & (F.col("label") < F.col("own"))))
    return df.join(F.broadcast(own)).groupBy("own").agg(F.count_if(before).alias("place")).withColumnRenamed("own", "label")


def even_sample(df: DataFrame, k: int, label: str = "label") -> DataFrame:
    """``k`` rows at even steps in label order: place i * (n - 1) div (k - 1);
    for one the first; all rows where there are fewer."""
    indexed = with_index(df, label)
    n = indexed.count()
    if n <= k:
        return indexed
    wanted = {i * (n - 1) // (k - 1) for i in range(k)} if k > 1 else {0}
    return indexed.where(F.col("index").isin(sorted(wanted)))


def membership_hash(df: DataFrame, binding: str, label: str = "label", *by: str) -> DataFrame:
    """Digest of the set of labels of each group: the labels' own digests in
    order of 4096 ranges of them, then the digest of those digests, so no
    group is gathered in one row. Gives n and digest."""
    piece = df.select(*by, F.col(label).alias("_l"), F.expr(f"cast(floor({label} / 4096) as bigint)").alias("_r")).distinct()
    ranges = piece.groupBy(*by, "_r").agg(F.count("*").alias("_n"), F.sha2(F.array_join(F.sort_array(F.collect_list("_l")).cast("array<string>"), ","), 256).alias("_d"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_d"))), lambda s: s["_d"]), ",")
    return ranges.groupBy(*by).agg(F.sum("_n").alias("n"), F.sha2(F.concat(F.lit(binding + ":"), whole), 256).alias("digest"))


def population_query(df: DataFrame, ranges: dict, metric: str, order_metric: str, selected: int, *, descending: bool = False, offset: int = 0, limit: int = 50, bins: int = 8, sample: int = 13, binding: str = "population", label: str = "label") -> DataFrame:
    """Every part of a population's answer as rows (part, place, name, label,
    value, text), from one filtered table that is written once: accounting of
    the filters, summary, histogram, missing values, a page in order, the place
    of the selected label, an even sample and the digest of the members."""
    long = lambda part, place="0", name="''", label="null", value="null", text="null": [f"'{part}' as part", f"cast({place} as bigint) as place", f"cast({name} as string) as name", f"cast({label} as bigint) as label", f"cast({value} as double) as value", f"cast({text} as string) as text"]
    of = lambda one, part: one.unpivot([], [F.col(c).cast("double").alias(c) for c in one.columns], "name", "value").selectExpr(*long(part, name="name", value="value"))
    kept = written(range_filters(df, ranges).select(label, *sorted({metric, order_metric, *ranges} - {label})))
    shown = page(kept.select(F.col(label).alias("label"), order_metric), ordering(order_metric, descending), offset, limit)
    shown = shown.withColumn("place", F.row_number().over(W.orderBy(*ordering(order_metric, descending))) - 1 + offset)  # a page's rows alone
    hist = histogram(kept, metric, bins)
    parts = [
        of(filter_accounting(df, ranges), "filters"),
        of(summary(kept, metric), "summary"),
        hist.selectExpr(*long("histogram", "bin", "'n'", value="n")),
        hist.selectExpr(*long("histogram", "bin", "'low'", value="low")),
        hist.selectExpr(*long("histogram", "bin", "'high'", value="high")),
        missing_counts(kept, *sorted({metric, order_metric})).selectExpr(*long("missing", name="metric", value="missing")),
        shown.selectExpr(*long("page", "place", f"'{order_metric}'", "label", f"`{order_metric}`")),
        selected_rank(kept.withColumnRenamed(label, "label"), order_metric, selected, descending).selectExpr(*long("rank", "place", label="label")),
        even_sample(kept.select(F.col(label).alias("label"), metric), sample).selectExpr(*long("sample", "index", f"'{metric}'", "label", f"`{metric}`")),
        membership_hash(kept, binding, label).selectExpr(*long("members", "n", text="digest")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
