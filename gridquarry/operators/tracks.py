"""Detections over time: links, tracks and their measures.

Detections are rows (seq, frame, label, x, y), edges are rows (src, dst).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridquarry.sources.workspace import broadcast_if_small, shuffled, with_index, written

from . import graphs
from .matching import sequential_matching


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def candidates(det: DataFrame, most: float, gap: int = 0) -> DataFrame:
    """Pairs of detections of a sequence at most ``most`` apart, one to
    ``gap`` + 1 frames on. The plane is cut into squares of that size: a pair
    lies in one square or in neighbours, so the join is on equal keys."""
    at = lambda c: F.floor(F.col(c) / most).cast("bigint")
    a = det.select("seq", F.col("frame").alias("f1"), F.col("label").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), at("x").alias("cx"), at("y").alias("cy"))
    around = F.array(*(F.struct((at("x") + i).alias("cx"), (at("y") + j).alias("cy"), (F.col("frame") - k).alias("f1"), F.lit(k).alias("step")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in range(1, gap + 2)))
    b = det.select("seq", F.col("label").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(around).alias("k")).select("seq", "dst", "x2", "y2", "k.*")
    far = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)
    return a.join(shuffled(b), ["seq", "f1", "cx", "cy"]).withColumn("distance", far).where(F.col("distance") <= most).select("seq", F.col("f1").alias("frame"), "src", "dst", "step", "distance")


def links(pairs: DataFrame, gap: int = 0) -> DataFrame:
    """The candidates that link detections one to one: in each pair of frames
    most links, then the least total distance; with ``gap``, what a frame has
    left goes to later frames, in order of the frames."""
    return sequential_matching(pairs, "seq", gap)


def ambiguity(pairs: DataFrame, links: DataFrame, slack: float) -> DataFrame:
    """Of each link the number of other candidates of its source and of its
    target in the same pair of frames that are at most ``slack`` farther, and
    what that makes it: ambiguous, a possible split, a possible merge."""
    own = links.select("seq", "frame", "step", "src", "dst", F.col("distance").alias("own"))
    count = lambda key, other: own.join(pairs.select("seq", "frame", "step", F.col(key), F.col(other).alias("o"), "distance"), ["seq", "frame", "step", key]).where((F.col("o") != F.col(other)) & (F.col("distance") <= F.col("own") + slack)).groupBy("seq", key).agg(F.count("*").alias(f"by_{key}"))
    out = own.join(count("src", "dst"), ["seq", "src"], "left").join(count("dst", "src"), ["seq", "dst"], "left").fillna(0, ["by_src", "by_dst"])
    split, merge = F.col("by_src") > 0, F.col("by_dst") > 0
    return out.select("seq", "src", "dst", F.col("by_src").alias("by_source"), F.col("by_dst").alias("by_target"), (split | merge).alias("ambiguous"), split.alias("split"), merge.alias("merge"))


#: Frames in a row that one task goes through.
FRAME_BLOCK = 65_536


def _running_sum(df: DataFrame, place: str, value: str, block: int) -> DataFrame:
    """``df`` with _sum, the sum of ``value`` over rows up to a row's place:
    within blocks of places, whose own sums are a row a block."""
    df = written(df.withColumn("_block", F.expr(f"{place} div {block}")))
    sums = df.groupBy("_block").agg(F.sum(value).alias("_own"))
    before = sums.select("_block", (F.sum("_own").over(W.orderBy("_block")) - F.col("_own")).alias("_before"))
    within = F.sum(value).over(W.partitionBy("_block").orderBy(place))
    return df.withColumn("_sum", within).join(before, "_block").withColumn("_sum", F.col("_sum") + F.col("_before")).drop("_block", "_before")


def stretches(back: DataFrame, block: int = FRAME_BLOCK) -> DataFrame:
    """_i, part of the frames from ``early`` to ``late`` of any row of ``back``
    (places of frames). Rows that share a frame make one part, and so on."""
    turns = back.select(F.col("early").alias("_i"), F.lit(1).alias("turn")).union(back.select("late", F.lit(-1))).groupBy("_i").agg(F.sum("turn").alias("turn"))
    # Where the sum is 0, no row goes on to the next frame.
    closed = _running_sum(turns, "_i", "turn", block).select("_i", (F.col("_sum") == 0).cast("int").alias("closed"))
    parts = _running_sum(closed, "_i", "closed", block).groupBy((F.col("_sum") - F.col("closed")).alias("part")).agg(F.min("_i").alias("a"), F.max("_i").alias("b"))
    blocks = parts.select("part", "a", "b", F.explode(F.expr(f"sequence(a div {block}, b div {block})")).alias("k")).repartition("part", "k")
    return blocks.select(F.explode(F.expr(f"sequence(greatest(a, k * {block}), least(b, k * {block} + {block - 1}))")).alias("_i"), "part")


def edge_faults(det: DataFrame, edges: DataFrame, small: int = graphs.SMALL_EDGES) -> DataFrame:
    """Edges (src, dst, gap, cost, origin) of a track graph that break its
    rules, with the reasons: unknown ends, not forward in time, several edges
    out of or into a detection, on a cycle, a gap that isn't the number of
    frames between, a cost that isn't the distance, an origin that is neither
    automatic nor manual. ``det``: seq, frame, label, x, y; an edge between
    sequences has an unknown end.

    Whatever a cycle passes on its way forward in time it passes on its way
    back, so cycles are searched only among frames that edges not going
    forward span, in each stretch of such frames by itself (in a task up to
    ``small`` edges)."""
    # Places go on from one sequence to the next; only differences within one count.
    frames = with_index(det.select("seq", "frame").distinct(), "seq", "frame", name="_i")
    known = det.join(frames, ["seq", "frame"]).select("label", "seq", "frame", "_i", "x", "y")
    end = lambda name, n: known.select(F.col("label").alias(name), *(F.col(c).alias(f"{c}{n}") for c in ("seq", "frame", "_i", "x", "y")))
    e = written(edges.join(end("src", 1), "src", "left").join(end("dst", 2), "dst", "left"))
    joined = e.where("seq1 = seq2")
    spanned = broadcast_if_small(written(stretches(joined.where("frame2 <= frame1").select(F.col("_i2").alias("early"), F.col("_i1").alias("late")))))
    at = lambda n: spanned.select(F.col("_i").alias(f"_i{n}"), F.col("part").alias(f"part{n}"))
    turned = joined.select("src", "dst", "_i1", "_i2").join(at(1), "_i1").join(at(2), "_i2").where("part1 = part2")
    cyclic = graphs.cycle_edges_in_parts(turned.select("src", "dst", F.col("part1").alias("part")), small).withColumn("_cycle", F.lit(True))
    outs, ins = F.count("*").over(W.partitionBy("src")), F.count("*").over(W.partitionBy("dst"))
    far = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)
    near = F.abs(F.col("cost") - far) <= F.greatest(F.lit(1e-12), 1e-12 * F.greatest(F.abs("cost"), far))
    unknown = ~F.coalesce(F.col("seq1") == F.col("seq2"), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(unknown, "unknown"), F.when(F.col("frame2") <= F.col("frame1"), "backward"), F.when(F.col("outs") > 1, "branch"), F.when(F.col("ins") > 1, "merge"), F.when(F.col("_cycle"), "cycle"),
        F.when(~unknown & ~F.col("gap").eqNullSafe(F.col("_i2") - F.col("_i1") - 1), "gap"), F.when(~unknown & ~F.coalesce(near & (F.col("cost") >= 0), F.lit(False)), "cost"), F.when(~F.coalesce(F.col("origin").isin("automatic", "manual"), F.lit(False)), "origin"),
    ))
    told = e.withColumns({"outs": outs, "ins": ins}).join(cyclic, ["src", "dst"], "left").withColumn("reasons", reasons)
    return told.where(F.size("reasons") > 0).select("src", "dst", F.array_join("reasons", ",").alias("reasons"))


def chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each node the start of its chain of one-in one-out edges and the
    edges from there: pointer doubling, a join for each power of two of the
    longest chain. Branches, merges and cycles are refused."""
    edges = written(edges.select("src", "dst").distinct())
    for end in ("src", "dst"):
        if not edges.groupBy(end).count().where("count > 1").isEmpty():
            raise ValueError(f"a node has several edges of one {end}")
    step = written(nodes.join(edges.select(F.col("dst").alias("node"), F.col("src").alias("up")), "node", "left").select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("far")))
    rounds = step.count().bit_length() + 1
    while True:
        other = step.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("far").alias("more"))
        nxt = written(step.join(other, "up").select("node", F.col("top").alias("up"), (F.col("far") + F.col("more")).alias("far")))
        moved = nxt.agg(F.sum("far")).first()[0] != step.agg(F.sum("far")).first()[0]
        step, rounds = nxt, rounds - 1
        if not moved:
            return step.select("node", F.col("up").alias("track"), F.col("far").alias("depth"))
        if rounds < 0:
            raise ValueError("the edges make a cycle")


def observations(det: DataFrame, track: list[str], order: list[str]) -> DataFrame:
    """Per detection of a track: step, speed (step by frame, null within one),
    displacement from the start, path so far, gap in frames to the one before."""
    w = W.partitionBy(*track).orderBy(*order)
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    base = det.withColumns({"step": step, "x0": F.first("x").over(w), "y0": F.first("y").over(w), "gap": F.col("frame") - F.lag("frame").over(w)})
    path = F.sum(F.coalesce("step", F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return base.select(*track, *order, r(F.col("step"), 5).alias("step"), r(F.when(F.col("gap") > 0, F.col("step") / F.col("gap")), 5).alias("speed"), r(F.sqrt((F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2), 5).alias("displacement"), r(path, 3).alias("path"), "gap")


def step_intervals(det: DataFrame, track: list[str], order: list[str], seconds: str, usual: float) -> DataFrame:
    """Per detection the step to the next one of its track: vector, chord,
    velocity and speed over the actual time (null for none), and whether that
    is a gap, longer than ``usual``. Nulls for the last one."""
    w = W.partitionBy(*track).orderBy(*order)
    dx, dy, dt = (F.lead(c).over(w) - F.col(c) for c in ("x", "y", seconds))
    chord = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    over = lambda c: r(F.when(F.col("dt") > 0, c / F.col("dt")), 5)
    steps = det.select(*track, *order, dx.alias("dx"), dy.alias("dy"), dt.alias("dt"))
    return steps.select(*track, *order, r(F.col("dx")).alias("dx"), r(F.col("dy")).alias("dy"), r(chord, 5).alias("chord"), over(F.col("dx")).alias("vx"), over(F.col("dy")).alias("vy"), over(chord).alias("speed"), F.coalesce(F.col("dt") > usual, F.lit(False)).alias("gap"))


def track_measures(det: DataFrame, track: list[str], order: list[str], sure: float) -> DataFrame:
    """Per track: detections, frames passed, net displacement, path length,
    mean velocity and speed (null within one frame), directionality (null
    without a path), gaps, steps longer than ``sure``, and a status: single,
    stationary or moving."""
    w = W.partitionBy(*track).orderBy(*order)
    base = det.withColumns({"step": F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2), "gap": F.col("frame") - F.lag("frame").over(w)})
    key = F.struct(*order)
    s = base.groupBy(*track).agg(
        F.count("*").alias("n"), (F.max("frame") - F.min("frame")).alias("elapsed"), F.min_by(F.struct("x", "y"), key).alias("a"), F.max_by(F.struct("x", "y"), key).alias("b"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.count_if(F.col("gap") > 1).alias("gaps"), F.count_if(F.col("step") > sure).alias("uncertain")
    )
    over = lambda c: r(F.when(F.col("elapsed") > 0, c / F.col("elapsed")), 5)
    net = F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2)
    return s.select(*track, "n", "elapsed", r(net, 5).alias("net"), r(F.col("path"), 3).alias("path"), r(F.least(F.try_divide(net, F.col("path")), F.lit(1.0)), 5).alias("directionality"), over(F.col("b.x") - F.col("a.x")).alias("vx"), over(F.col("b.y") - F.col("a.y")).alias("vy"), over(F.col("path")).alias("speed"), "gaps", "uncertain", F.when(F.col("n") == 1, "single").when(F.col("path") == 0, "stationary").otherwise("moving").alias("status"))


def interval_rates(series: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """Change by unit of time since the frame before; null unless both are
    observed."""
    w = W.partitionBy(*key).orderBy(time)
    rate = F.try_divide(F.col(value) - F.lag(value).over(w), F.col(time) - F.lag(time).over(w))
    return series.select(*key, time, value, r(rate).alias("rate"))


def nearest(points: DataFrame, key: str, first_cell: float) -> DataFrame:
    """Distance of each point (group, x, y) to the nearest other of its group;
    null for a lone point."""
    return nearest_neighbours(points, points, key, first_cell).select(key, "nearest")


def nearest_neighbours(asked: DataFrame, points: DataFrame, key: str, first_cell: float) -> DataFrame:
    """key, nearest and neighbour of each of ``asked`` (key, group, x, y): the
    distance to the nearest other point of its group among ``points``, and the
    key of that one (of equally near ones the smallest); null for a lone point.

    The plane is cut into squares; a point's nearest within the size of a
    square lies in its own or a neighbouring one. What has no such neighbour is
    looked at again with squares twice as large, until all are settled or a
    group lies in one square. It is the asked points that look into nine
    squares, so a round costs what is left of them and one shuffle of the rest.
    """
    left, every = written(asked.select(key, "group", "x", "y")), written(points.select(key, "group", "x", "y"))
    spans = every.groupBy("group").agg(F.max(F.greatest("x", "y")).alias("hi"), F.min(F.least("x", "y")).alias("lo"))
    widest = spans.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0.0
    reach = left.agg(F.max(F.greatest("x", "y")), F.min(F.least("x", "y"))).first()
    ends = every.agg(F.max(F.greatest("x", "y")), F.min(F.least("x", "y"))).first()
    if None not in (*reach, *ends):
        widest = max(widest, reach[0] - ends[1], ends[0] - reach[1])
    done, size = None, first_cell
    while True:
        at = lambda c: F.floor(F.col(c) / size).cast("bigint")  # noqa: E731, B023
        around = F.array(*(F.struct((at("x") + i).alias("cx"), (at("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        own = left.select(key, "group", F.col("x").alias("x1"), F.col("y").alias("y1"), F.explode(around).alias("c")).select(key, "group", "x1", "y1", "c.*")
        others = every.select(F.col(key).alias("other"), "group", F.col("x").alias("x2"), F.col("y").alias("y2"), at("x").alias("cx"), at("y").alias("cy"))
        far = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)
        met = shuffled(own).join(others, ["group", "cx", "cy"]).where(F.col(key) != F.col("other")).groupBy(key).agg(F.min(F.struct(far.alias("nearest"), F.col("other").alias("neighbour"))).alias("m"))
        last = size > widest
        found = written(left.select(key).join(met, key, "left").select(key, "m.nearest", "m.neighbour"))
        settled = found if last else found.where(F.col("nearest") <= size)
        done = settled if done is None else done.union(settled)
        if last:
            return done
        left = written(left.join(settled, key, "left_anti"))
        if left.isEmpty():
            return done
        size *= 2


def remeasured(points: DataFrame, measured: DataFrame, removed: DataFrame, key: str, first_cell: float) -> DataFrame:
    """``measured`` (key, nearest, neighbour) after the points of ``removed``
    (key) are gone: only those whose neighbour went look again; all other rows
    stay as they are, whatever the size of the table."""
    gone = written(removed.select(F.col(key).alias("_gone")).distinct())
    left = measured.join(gone, measured[key] == gone["_gone"], "left_anti")
    stale = written(left.join(gone, left["neighbour"] == gone["_gone"], "left_semi").select(key))
    if stale.isEmpty():
        return left
    rest = points.join(gone, points[key] == gone["_gone"], "left_anti")
    again = nearest_neighbours(rest.join(stale, key, "left_semi"), rest, key, first_cell)
    return left.join(stale, key, "left_anti").select(key, "nearest", "neighbour").union(again.select(key, "nearest", "neighbour"))


def _settled(pdf: pd.DataFrame, most: float) -> pd.DataFrame:
    """Of a block's rows (id, x, y, response, state, own) those of its own that
    were open (state 0) and aren't suppressed, as kept (1) or still open: an
    open point depends on what lies beyond the block."""
    import numpy as np

    pdf = pdf.assign(_nan=pdf["response"].isna()).sort_values(["_nan", "response", "id"], ascending=[False, False, True], ignore_index=True)
    xs, ys, states, owns = (pdf[c].tolist() for c in ("x", "y", "state", "own"))
    kept: dict[tuple, list] = {}  # points of each square
    still: dict[tuple, list] = {}
    out = np.full(len(pdf), -1)
    for k, (x, y, state, own) in enumerate(zip(xs, ys, states, owns)):
        cx, cy = x // most, y // most
        around = [(i, j) for i in (cx - 1, cx, cx + 1) for j in (cy - 1, cy, cy + 1)]
        near = lambda held: any((x - u) ** 2 + (y - v) ** 2 < most * most for at in around for u, v in held.get(at, ()))  # noqa: E731, B023
        if state == 0:
            if near(kept):
                continue
            state = 1 if own and not (still and near(still)) else 0
            if own:
                out[k] = state
        (kept if state else still).setdefault((cx, cy), []).append((x, y))
    left = out >= 0
    return pdf.loc[left, ["id", "x", "y", "response"]].assign(state=out[left].astype("int32"))


def suppress(points: DataFrame, most: float, squares: int = 64) -> DataFrame:
    """Peaks (id, x, y, response) left by greedy suppression: in order of
    response (then id), one is kept if none within ``most`` was kept before.

    A task goes through the points of a block of ``squares`` times ``most`` a
    side and those around it. It settles its own unless they depend on an open
    one beyond the block; these go on to the next round, with the kept ones
    that other blocks see. Points without a place or response are kept.
    """
    # A block sees a little more than ``most`` around it, whatever the rounding.
    side, reach = squares * most, 2 * most
    at = lambda c, by: F.floor((F.col(c) + by) / side).cast("bigint")
    seen = F.array_distinct(F.array(*(F.struct(at("x", i).alias("bx"), at("y", j).alias("by")) for i in (-reach, 0.0, reach) for j in (-reach, 0.0, reach))))
    home = F.struct(at("x", 0.0).alias("bx"), at("y", 0.0).alias("by"))
    rows = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("response").cast("double").alias("response"), F.lit(0).alias("state"))
    placed = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col("response").isNotNull(), F.lit(False))
    kept, left, border = rows.where(~placed).select("id"), rows.where(placed), None
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    while True:
        dealt = (left if border is None else left.union(border)).select("*", F.explode(seen).alias("b")).select(*rows.columns, (F.col("b") == home).alias("own"), "b.*")
        # Only blocks with open points of their own are gone through.
        dealt = dealt.join(left.select(home.alias("b")).distinct().select("b.*"), ["bx", "by"], "left_semi")
        told = written(dealt.groupBy("bx", "by").applyInPandas(lambda pdf: _settled(pdf, most), kinds))
        kept = kept.union(told.where("state = 1").select("id"))
        left = told.where("state = 0")
        if left.isEmpty():
            return kept
        fixed = told.where("state = 1").where(F.size(seen) > 1)
        border = fixed if border is None else border.union(fixed)


def edited(edges: DataFrame, ledger: DataFrame) -> DataFrame:
    """graph, src, dst, origin (automatic or manual) of the edges (graph, src,
    dst) after a ledger (graph, seq, op, src, dst) of edits: add and remove
    change an edge, undo takes the graph's last edit back, redo does it again
    until there is a new edit.

    Each graph has a stack of its own; graphs are gone through side by side,
    one graph's edits (a person's work on it) in a task."""
    by_hand = placed_edits(ledger.where(F.col("op").isin("add", "remove", "undo", "redo")))
    last = by_hand.groupBy("graph", "src", "dst").agg(F.max_by("op", "seq").alias("op"))
    kept = edges.select("graph", "src", "dst").join(last, ["graph", "src", "dst"], "left_anti").withColumn("origin", F.lit("automatic"))
    return kept.union(last.where("op = 'add'").select("graph", "src", "dst", F.lit("manual")))


def placed_edits(ledger: DataFrame) -> DataFrame:
    """The edits (graph, seq, op, src, dst) of each graph that stand at the
    ledger's end."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        done: list[int] = []
        undone: list[int] = []
        for k, op in enumerate(pdf["op"]):
            if op == "undo":
                if done:
                    undone.append(done.pop())
            elif op == "redo":
                if undone:
                    done.append(undone.pop())
            else:
                done.append(k)
                undone.clear()
        return pdf.iloc[sorted(done)]

    own = ledger.select("graph", "seq", "op", "src", "dst")
    return own.groupBy("graph").applyInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields))
