"""Directed cycles of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridquarry.sources.workspace import written

#: Edges that one task searches for what is left of a graph: some 50 MB.
SMALL_EDGES = 500_000


def _strong_edges(pdf: pd.DataFrame) -> pd.Series:
    """Whether both ends of each edge (src, dst) are in one strong component,
    by one walk in depth with a stack of its own."""
    import numpy as np

    names, codes = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
    a, b = codes[: len(pdf)], codes[len(pdf) :]
    order = np.argsort(a, kind="stable")
    ahead, begins = b[order].tolist(), np.searchsorted(a[order], np.arange(len(names) + 1)).tolist()
    place = begins[:-1].copy()
    number, low, part = [0] * len(names), [0] * len(names), [-1] * len(names)
    count, open_nodes = 0, []
    for root in range(len(names)):
        if number[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not number[v]:
                count += 1
                number[v] = low[v] = count
                open_nodes.append(v)
            if place[v] < begins[v + 1]:
                w = ahead[place[v]]
                place[v] += 1
                if not number[w]:
                    path.append(w)
                elif part[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == number[v]:
                while True:
                    w = open_nodes.pop()
                    part[w] = v
                    if w == v:
                        break
    part = np.array(part)
    return pd.Series(part[a] == part[b], index=pdf.index)


def _small_cycles(edges: DataFrame) -> DataFrame:
    """ids of the edges inside strong components, of a small graph."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield whole.loc[_strong_edges(whole), ["id"]]

    return edges.select("src", "dst", "id").coalesce(1).mapInPandas(run, "id bigint")


def _degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("outs"), F.sum("i").alias("ins"))


def _with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with the nodes' columns, those of src as a_, of dst as b_."""
    for end, mark in (("src", "a_"), ("dst", "b_")):
        edges = edges.join(nodes.select(F.col("node").alias(end), *(F.col(c).alias(mark + c) for c in nodes.columns if c != "node")), end)
    return edges


def _core_cycles(edges: DataFrame) -> DataFrame:
    """ids of the edges inside strong components, by forward colours and
    backward marks; rounds as many as the longest path of ``edges``."""
    found = edges.select("id").where("false")
    while not edges.isEmpty():
        colour = written(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            ahead = edges.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("more"))
            new = written(colour.join(ahead, "node", "left").select("node", F.greatest("colour", "more").alias("colour"), (F.col("more") > F.col("colour")).alias("moved")))
            colour = new.select("node", "colour")
            if new.where("moved").isEmpty():
                break
        marked = written(colour.where("node = colour"))
        while True:
            behind = edges.join(marked.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "colour").join(colour, ["node", "colour"], "left_semi").distinct()
            fresh = written(behind.join(marked, ["node", "colour"], "left_anti"))
            if fresh.isEmpty():
                break
            marked = written(marked.union(fresh))
        ends = _with_ends(edges, marked)
        found = found.union(written(ends.where("a_colour = b_colour").select("id")))
        edges = written(edges.join(marked.select(F.col("node").alias("src")), "src", "left_anti").join(marked.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return found


def cycle_edges(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """src, dst of the edges that lie on a directed cycle; self-loops are one.

    Edges into a node without a way on, or from one without a way in, go.
    Nodes with one edge in and one out are passed over: about a quarter of them
    a round, chosen so that no two are neighbours, so a chain of any length is
    done in a number of rounds that grows with its logarithm. What closes on
    itself is a cycle, and so is all that was passed over on the way. As soon
    as ``small`` edges are left at most, one task searches their strong
    components; where more remain and all are branches, Spark does.
    """
    whole = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("id", F.xxhash64("src", "dst")))
    loops = whole.where("src = dst").select("id")
    left = written(whole.where("src <> dst"))
    merged: list[DataFrame] = []
    turn = 0
    while (few := left.limit(small + 1).count()) > small:
        turn += 1
        nodes = _degrees(left)
        picked = (F.col("ins") == 1) & (F.col("outs") == 1) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)
        nodes = written(nodes.withColumn("open", (F.col("ins") > 0) & (F.col("outs") > 0)).withColumn("simple", (F.col("ins") == 1) & (F.col("outs") == 1)).withColumn("raw", picked))
        if nodes.where("not open or simple").isEmpty():
            break  # branches alone
        ends = written(_with_ends(left, nodes.select("node", "open", "raw")).where("a_open and b_open"))
        # A node is passed over if it was picked and the one before it wasn't; both ends stay open.
        first = ends.where("b_raw and not a_raw").select(F.col("dst").alias("mid"), F.col("src").alias("from"), F.col("id").alias("kept"))
        second = ends.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("id").alias("gone"))
        joined = written(first.join(second, "mid"))
        merged.append(joined.select("gone", "kept"))
        rest = ends.join(joined.select(F.col("gone").alias("id")).union(joined.select("kept")), "id", "left_anti").select("src", "dst", "id")
        left = rest.union(joined.select(F.col("from").alias("src"), F.col("to").alias("dst"), F.col("kept").alias("id")))
        left = written(left)
        loops = loops.union(written(left.where("src = dst").select("id")))
        left = written(left.where("src <> dst"))
    found = written(loops.union(_small_cycles(left) if few <= small else _core_cycles(left)))
    for step in reversed(merged):
        found = written(found.union(step.join(found.withColumnRenamed("id", "kept"), "kept", "left_semi").select(F.col("gone").alias("id"))))
    return whole.join(found.distinct(), "id", "left_semi").select("src", "dst")


def cycle_edges_in_parts(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """src, dst of the edges (src, dst, part) that lie on a directed cycle,
    where no cycle leaves its part.

    Parts of ``small`` edges at most are sorted into tasks, which search a batch
    of whole parts at a time; edges of larger parts go through ``cycle_edges``."""
    whole = written(edges.select("src", "dst", "part").distinct())
    # A row for each ``small`` edges at most, hence a broadcast.
    large = written(whole.groupBy("part").count().where(F.col("count") > small).select("part"))
    ends = StructType(whole.schema.fields[:2])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of one part, which may go on
        for batch in batches:
            if batch.empty:
                continue
            part = batch["part"]
            if held and held[0]["part"].iloc[0] == part.iloc[-1]:
                held.append(batch)
                continue
            ready = pd.concat([*held, batch[part != part.iloc[-1]]], ignore_index=True)
            held = [batch[part == part.iloc[-1]]]
            if len(ready):
                yield ready.loc[_strong_edges(ready), ["src", "dst"]]
        if held:
            ready = pd.concat(held, ignore_index=True)
            yield ready.loc[_strong_edges(ready), ["src", "dst"]]

    found = whole.join(F.broadcast(large), "part", "left_anti").repartition("part").sortWithinPartitions("part").select("src", "dst", "part").mapInPandas(run, ends)
    if not large.isEmpty():
        found = found.union(cycle_edges(whole.join(F.broadcast(large), "part", "left_semi"), small))
    return written(found.distinct())
