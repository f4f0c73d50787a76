"""Splits of a training set: assignment by path rules, and records that link
two splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridquarry.sources.workspace import broadcast_if_small, written

from .components import connected_components


def path_parts(path: Column) -> Column:
    """The parts of a relative path in lower case, without empty ones and
    dots; null for a path that is absolute, has a part "..", a drive or a
    backslash, or no part at all."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: (p != "") & (p != "."))
    refused = path.startswith("/") | path.contains("\\") | path.rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~F.coalesce(refused, F.lit(True)), parts)


def assign_splits(paths: DataFrame, rules: DataFrame, key: str, path: str = "path") -> DataFrame:
    """key, split, rule, splits: the split of each path by the rules (split,
    prefix) that it lies within, whole parts and without regard to case;
    ``unassigned`` where there is none. Where rules of several splits match,
    split is null (a conflict) and splits lists them; rule is the longest
    matching prefix. A path that isn't relative has the split ``refused``.

    Each path meets the rules by equality with its ancestors, one for each
    number of parts that some rule has: the work is the same for ten rules as
    for a million. Rows of ``paths`` are told apart by ``key``.
    """
    cut = lambda parts: F.array_join(parts, "/")
    known = rules.select(F.col("split"), path_parts(F.col("prefix")).alias("_p")).where("_p is not null").select("split", cut(F.col("_p")).alias("_prefix"), F.size("_p").alias("_n"))
    by_prefix = written(known.groupBy("_prefix", "_n").agg(F.collect_set("split").alias("_splits")))
    lengths = [r["_n"] for r in by_prefix.select("_n").distinct().collect()]  # as many as paths are deep
    rows = paths.select(F.col(key), path_parts(F.col(path)).alias("_parts"))
    ancestors = F.array(*(F.when(F.size("_parts") >= n, F.struct(F.lit(n).alias("_n"), cut(F.slice("_parts", 1, n)).alias("_prefix"))) for n in sorted(lengths))) if lengths else F.array().cast("array<struct<_n:int,_prefix:string>>")
    met = rows.select(key, F.explode(F.array_compact(ancestors)).alias("_a")).select(key, "_a.*")
    hits = met.join(broadcast_if_small(by_prefix), ["_prefix", "_n"])
    matched = hits.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_splits")))).alias("splits"), F.max_by("_prefix", "_n").alias("rule"))
    joined = rows.join(matched, key, "left")
    split = F.when(F.col("_parts").isNull(), "refused").when(F.col("splits").isNull(), "unassigned").when(F.size("splits") == 1, F.col("splits")[0])
    return joined.select(key, split.alias("split"), "rule", F.coalesce("splits", F.array().cast("array<string>")).alias("splits"))


def leaks(records: DataFrame, key: str, split: str, links: dict[str, Column]) -> DataFrame:
    """component, records, splits, repeated: the groups of records that any of
    ``links`` (such as content hash, path, acquisition group) ties together,
    also over several steps, and that lie in more than one split. component is
    the smallest key, repeated the links that two records of it share.

    Each record is tied to the smallest one of the same value, so a value of
    very many records makes a tie a record, not one a pair. Null values tie
    nothing; rows with equal keys are one record, tied by its key.
    """
    values = F.array(*(F.when(c.isNotNull(), F.struct(F.lit(name).alias("link"), c.cast("string").alias("value"))) for name, c in links.items()))
    long = written(records.select(F.col(key).alias("src"), F.col(split).alias("split"), F.explode(F.array_compact(values)).alias("v")).select("src", "split", "v.*"))
    shared = long.groupBy("link", "value").agg(F.min("src").alias("dst"), F.max("src").alias("last"), F.count("*").alias("n")).where("n > 1")
    shared = written(shared)
    ties = written(long.join(shared.select("link", "value", "dst", (F.col("dst") < F.col("last")).alias("apart")), ["link", "value"]))
    roots = written(connected_components(ties.where("apart").select("src", "dst")))
    whole = records.select(F.col(key).alias("node"), F.col(split).alias("split")).join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    kinds = ties.select(F.col("src").alias("node"), "link").distinct().join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("component")).agg(F.array_sort(F.collect_set("link")).alias("repeated"))
    told = whole.groupBy("component").agg(F.count("*").alias("records"), F.array_sort(F.collect_set("split")).alias("splits"))
    return told.where(F.size("splits") > 1).join(kinds, "component").select("component", "records", F.array_join("splits", ",").alias("splits"), F.array_join("repeated", ",").alias("repeated"))
