"""One-to-one matching: most pairs first, then the least total cost.

Pairs whose ends have no other candidate are taken as they are, by windows.
The rest, the contested ones, are solved component by component, many
components in one call: dealt by group (an image, a pair of frames), or by
component where a group has very many.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.sources.workspace import written

from .components import connected_components, least_labels

#: Rows times columns of a cost table; larger components are solved on lists.
MOST_CELLS = 4_000_000
#: Contested pairs of a group that one task holds; larger groups are dealt by component.
TOGETHER = 200_000


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row (no more rows than columns) in an assignment of the
    least total cost: shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
    for row in range(1, n + 1):
        row_of[0], at = row, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[at] = True
            reached = cost[row_of[at] - 1] - u[row_of[at]] - v[1:]
            better = ~used[1:] & (reached < least[1:])
            least[1:][better], way[1:][better] = reached[better], at
            nearest = int(np.where(used, np.inf, least)[1:].argmin()) + 1
            delta = least[nearest]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            at = nearest
            if row_of[at] == 0:
                break
        while at:
            row_of[at] = row_of[way[at]]
            at = way[at]
    out = np.empty(n, dtype=np.int64)
    for column in range(1, m + 1):
        if row_of[column]:
            out[row_of[column] - 1] = column - 1
    return out


def sparse_assignment(rows: np.ndarray, columns: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Indices of the pairs of a matching with most pairs and then the least
    total cost, by shortest augmenting paths over the pairs there are: memory
    in proportion to them. A row may stay alone at a cost above all others."""
    n, m = int(rows.max()) + 1, int(columns.max()) + 1
    alone = (n + 1) * (float(cost.max()) + 1.0)
    order = np.argsort(rows, kind="stable")
    begins = np.searchsorted(rows[order], np.arange(n + 1)).tolist()
    pairs, ends, costs = order.tolist(), columns[order].tolist(), cost[order].astype(float).tolist()
    u, v = [0.0] * n, [0.0] * m
    held, owner = [-1] * n, [-1] * m  # a row's place in the lists, a column's row
    for start in range(n):
        near: dict[int, float] = {}
        via: dict[int, tuple[int, int]] = {}
        done: dict[int, None] = {}
        heap: list[tuple[float, int]] = []
        row, base, last_alone, left_alone, free = start, 0.0, np.inf, -1, -1
        while True:
            for k in range(begins[row], begins[row + 1]):
                j = ends[k]
                if j in done:  # settled; rounding must not open it again
                    continue
                d = base + costs[k] - u[row] - v[j]
                if d < near.get(j, np.inf):
                    near[j], via[j] = d, (row, k)
                    heapq.heappush(heap, (d, j))
            if base + alone - u[row] < last_alone:
                last_alone, left_alone = base + alone - u[row], row
            while heap and heap[0][0] > near[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= last_alone:
                total = last_alone
                break
            base, j = heapq.heappop(heap)
            if owner[j] < 0:
                total, free = base, j
                break
            done[j] = None
            near[j] = base
            row = owner[j]
        u[start] += total
        for j in done:
            u[owner[j]] += total - near[j]
            v[j] -= total - near[j]
        if free < 0:
            if left_alone == start:
                continue
            free = ends[held[left_alone]]
            held[left_alone] = -1
        while True:
            row, k = via[free]
            before = held[row]
            held[row], owner[free] = k, row
            if row == start:
                break
            free = ends[before]
    return np.array(sorted(pairs[k] for k in held if k >= 0), dtype=np.int64)


def matched(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which of the pairs a - b (costs from 0) make the matching with most
    pairs and, among those, the least total cost."""
    a = np.unique(a, return_inverse=True)[1]
    b = np.unique(b, return_inverse=True)[1]
    keep = np.zeros(len(a), dtype=bool)
    if not len(a):
        return keep
    many = int(a.max()) + 1
    component = least_labels(many + int(b.max()) + 1, a, b + many)[a]
    order = np.argsort(component, kind="stable")
    for pairs in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
        if len(pairs) == 1:
            keep[pairs] = True
            continue
        rows, r = np.unique(a[pairs], return_inverse=True)
        columns, c = np.unique(b[pairs], return_inverse=True)
        if len(rows) > len(columns):
            rows, r, columns, c = columns, c, rows, r
        if len(rows) * len(columns) > MOST_CELLS:
            keep[pairs[sparse_assignment(r, c, cost[pairs])]] = True
            continue
        table = np.full((len(rows), len(columns)), (len(rows) + 1) * (float(cost[pairs].max()) + 1.0))
        which = np.full(table.shape, -1)
        which[r, c] = pairs
        table[r, c] = cost[pairs]
        found = which[np.arange(len(rows)), assignment(table)]
        keep[found[found >= 0]] = True
    return keep


def _solved(pairs: DataFrame, deal: list[str], group: list[str], first: str, second: str) -> DataFrame:
    """The matching of contested pairs, many groups a call. ``deal``: columns
    that hold whole components together."""
    names = [f.name for f in pairs.schema.fields]

    def solve(pdf: pd.DataFrame) -> np.ndarray:
        ends = [pdf.groupby([*group, end], sort=False, dropna=False).ngroup().to_numpy() for end in (first, second)]
        return matched(*ends, pdf["_cost"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            rest = here if rest is None else pa.concat_tables([rest, here])
            codes = rest.select(deal).to_pandas().groupby(deal, sort=False, dropna=False).ngroup().to_numpy()
            whole = int(np.searchsorted(codes, codes[-1]))  # the last group may go on
            if whole:
                part = rest.slice(0, whole).combine_chunks()
                yield from part.filter(pa.array(solve(part.to_pandas()))).to_batches()
                rest = rest.slice(whole)
        if rest is not None and len(rest):
            rest = rest.combine_chunks()
            yield from rest.filter(pa.array(solve(rest.to_pandas()))).to_batches()

    dealt = pairs.repartition(*deal).sortWithinPartitions(*deal, *(c for c in [*group, first, second] if c not in deal))
    return dealt.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)).select(*names)


def best_matching(pairs: DataFrame, group: list[str], first: str, second: str, cost: str, together: int = TOGETHER) -> DataFrame:
    """The rows of ``pairs`` (one a pair of ``first`` and ``second``) that make
    the matching with most pairs and then the least total ``cost`` in each
    group. Equal totals are decided by the order of the ends. A task holds the
    contested pairs of some groups, or, where a group has more than
    ``together``, of some components of the graph that the pairs make."""
    alone = lambda end: F.count("*").over(W.partitionBy(*group, end)) == 1
    rows = pairs.withColumn("_cost", F.col(cost).cast("double")).withColumn("_lone", alone(first) & alone(second))
    rows = written(rows)
    contested = rows.where("not _lone").drop("_lone")
    largest = contested.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= together:
        solved = _solved(contested, group, group, first, second)
    else:
        node = lambda side, end: F.struct(*group, F.lit(side).alias("_side"), F.col(end).alias("_end"))
        roots = connected_components(contested.select(node(0, first).alias("src"), node(1, second).alias("dst")))
        # Roots themselves aren't among the nodes.
        placed = contested.join(roots.withColumnRenamed("root", "_root"), node(0, first) == F.col("node"), "left").withColumn("_root", F.coalesce("_root", node(0, first))).drop("node")
        solved = _solved(placed.withColumn("_root", F.to_json("_root")), ["_root"], group, first, second).drop("_root")
    return rows.where("_lone").drop("_lone", "_cost").unionByName(solved.drop("_cost"))


def sequential_matching(pairs: DataFrame, sequence: str, gap: int) -> DataFrame:
    """Links over gaps: the sources of each frame in turn are matched with the
    frame after it, then those left with the next one, up to ``gap`` frames
    further, each time with the targets that are still free. ``pairs``:
    sequence, frame, step, src, dst, distance. Frames depend on those before, so with a gap a sequence is gone through in
    one task, which holds the candidates of a frame and the targets that were
    taken in the frames it reaches; without one, frames are matched each by
    itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = (None, None)
        used_a: set = set()
        used_b: dict = {}  # the labels that were taken in each frame

        def solve(part: pa.Table) -> list[pa.RecordBatch]:
            nonlocal now, used_a
            at, frame, step = (part[c][0].as_py() for c in (sequence, "frame", "step"))
            if (at, frame) != now:
                used_a = set()
                for k in [k for k in used_b if at != now[0] or k <= frame]:
                    del used_b[k]
                now = at, frame
            taken = used_b.setdefault(frame + step, set())
            pdf = part.select(["src", "dst", "distance"]).to_pandas()
            free = np.flatnonzero(~(pdf["src"].isin(used_a) | pdf["dst"].isin(taken)).to_numpy())
            pdf = pdf.iloc[free]
            keep = matched(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["distance"].to_numpy())
            used_a.update(pdf["src"][keep])
            taken.update(pdf["dst"][keep])
            return part.take(pa.array(free[keep])).to_batches()

        key = [sequence, "frame", "step"]
        rest: list[pa.Table] = []
        for batch in batches:
            here = pa.Table.from_batches([batch])
            codes = here.select(key).to_pandas().groupby(key, sort=False, dropna=False).ngroup().to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for a, b in zip(ends, ends[1:]):
                part = here.slice(a, b - a)
                if rest and any(rest[0][c][0].as_py() != part[c][0].as_py() for c in key):
                    yield from solve(pa.concat_tables(rest).combine_chunks())
                    rest = []
                rest.append(part)
        if rest:
            yield from solve(pa.concat_tables(rest).combine_chunks())

    if not gap:
        return best_matching(pairs, [sequence, "frame"], "src", "dst", "distance")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.repartition(sequence).sortWithinPartitions(sequence, "frame", "step", "src", "dst").mapInArrow(run, kinds)
