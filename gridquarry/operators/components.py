"""Connected components: of edge tables by star contraction, of grids block by
block first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.sources.workspace import shuffled, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (src, dst)
    reaches. Nodes that reach no smaller one, roots among them, don't occur.

    Each round hangs every node's larger neighbours on its smallest one, then
    every node's smaller neighbours too, until all edges lead to a root. Only
    minima are gathered for a node, never its neighbours; the minima are
    written before they are joined, so that Spark can split the partition of a
    node with very many edges.
    """
    edges = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before, after = None, _mark(edges)
    while before != after and after[0]:
        both = edges.union(edges.select("dst", "src"))
        least = written(both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low")))
        larger = written(both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct())
        least = written(larger.groupBy("src").agg(F.min("dst").alias("low")))
        smaller = larger.join(least, "src").where("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        edges = written(smaller.union(least.select("src", F.col("low").alias("dst"))).distinct())
        before, after = after, _mark(edges)
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def least_labels(n: int, a, b):
    """The least number that each of 0 to n - 1 reaches by the edges a - b."""
    import numpy as np

    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def grid_components(cells: DataFrame, axes: list[str], steps: list[tuple[int, ...]], block: int, group: list[str] | None = None, value: str | None = None) -> DataFrame:
    """group, axes and root: the least node of each cell's component. ``cells``
    has the columns ``node`` (a number of its own), ``axes`` (places) and maybe
    ``value``, which neighbours must share; ``steps`` lead to the neighbours
    ahead of a cell.

    Components inside blocks of ``block`` cells a side are found first, a block
    in a task; then only cells at a block's border meet, and the components
    that touch there are the nodes of the contraction.
    """
    import numpy as np

    group = group or []
    extra = [value] if value else []
    blocks = {f"_b{i}": F.floor(F.col(a) / block) for i, a in enumerate(axes)}
    own = cells.select(*group, *axes, "node", *extra)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        at = [(pdf[a] - pdf[a].min()).to_numpy() + 1 for a in axes]
        index = np.full([int(p.max()) + 2 for p in at], -1)
        index[tuple(at)] = np.arange(len(pdf))
        a, b = [], []
        for step in steps:
            other = index[tuple(p + s for p, s in zip(at, step))]
            met = np.flatnonzero(other >= 0)
            if value:
                met = met[pdf[value].to_numpy()[met] == pdf[value].to_numpy()[other[met]]]
            a.append(met), b.append(other[met])
        low = least_labels(len(pdf), np.concatenate(a), np.concatenate(b))
        return pdf[[*group, *axes, "node", *extra]].assign(root=pdf["node"].to_numpy()[low])

    local = written(own.withColumns(blocks).groupBy(*group, *blocks).applyInPandas(within, f"{kinds}, root {own.schema['node'].dataType.simpleString()}"))
    border = F.lit(False)
    for a in axes:
        border = border | F.pmod(F.col(a), F.lit(block)).isin(0, block - 1)
    rim = local.where(border)
    moves = F.array(*(F.struct(*((F.col(a) + s).alias(a) for a, s in zip(axes, step))) for step in steps))
    ahead = rim.select(*group, F.explode(moves).alias("_at"), F.col("root").alias("src"), *(F.col(c).alias(f"_{c}") for c in extra)).select(*group, "_at.*", "src", *(f"_{c}" for c in extra))
    met = shuffled(ahead).join(rim, [*group, *axes])
    if value:
        met = met.where(F.col(value) == F.col(f"_{value}"))
    roots = connected_components(met.select("src", F.col("root").alias("dst")).where("src <> dst"))
    placed = local.join(roots.withColumnRenamed("root", "_root"), local.root == roots.node, "left")
    return placed.select(*(local[c] for c in (*group, *axes)), F.coalesce("_root", local["root"]).alias("root"))
