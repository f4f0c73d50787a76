"""Sets of labels: saved groups and their combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(groups: list[DataFrame], label: str = "label") -> DataFrame:
    return reduce(DataFrame.union, (g.select(label) for g in groups)).distinct()


def intersection(groups: list[DataFrame], label: str = "label") -> DataFrame:
    """Labels in all groups: one shuffle, however many groups."""
    tagged = [g.select(label, F.lit(1 << i).cast("bigint").alias("_g")) for i, g in enumerate(groups)]
    return reduce(DataFrame.union, tagged).groupBy(label).agg(F.bit_or("_g").alias("_in")).where(F.col("_in") == (1 << len(groups)) - 1).select(label)


def unclassified(universe: DataFrame, groups: list[DataFrame], label: str = "label") -> DataFrame:
    """Labels of the universe in no group; without groups, all of them."""
    own = universe.select(label).distinct()
    return own.join(union(groups, label), label, "left_anti") if groups else own


def outside(labels: DataFrame, universe: DataFrame, label: str = "label") -> DataFrame:
    """Labels that the universe lacks: empty for a subset."""
    return labels.select(label).distinct().join(universe.select(label), label, "left_anti")


def evaluate(name: str, groups: dict[str, DataFrame], definitions: dict[str, tuple[str, list[str]]], universe: DataFrame, deepest: int = 16) -> DataFrame:
    """A group defined by other groups (union, intersection or unclassified),
    from the bottom up; a cycle or more than ``deepest`` levels is an error."""

    def of(name: str, path: tuple[str, ...]) -> DataFrame:
        if name in path or len(path) > deepest:
            raise ValueError(f"group {name} refers to itself or is too deep")
        if name in groups:
            return groups[name]
        mode, operands = definitions[name]
        parts = [of(o, (*path, name)) for o in operands]
        return {"union": union, "intersection": intersection}[mode](parts) if mode != "unclassified" else unclassified(universe, parts)

    return of(name, ()).select("label")


def checked_append(current: DataFrame, incoming: DataFrame, key: str, revision: str) -> DataFrame:
    """Incoming rows with accepted: whether the revision they expect is the
    current one (none for a new key)."""
    return incoming.join(current, key, "left").select(*incoming.columns, (F.col("current").isNull() | (F.col(revision) == F.col("current"))).alias("accepted"))
