"""Exploded rows aren't broadcast, and loops don't carry pairs along."""

import random

from pyspark.sql import functions as F

from gridquarry.llm import simhash
from gridquarry.operators import graphs, matching, shapes, tracks
from gridquarry.plans import QUERIES, spatial_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_points_of_fingerprints_are_not_broadcast(spark):
    fps = spark.range(100).select(F.xxhash64("id").alias("fp"))
    assert "Broadcast" not in plan(simhash.close_fingerprints(fps))


def test_edges_of_polygons_are_not_broadcast(spark):
    i = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")
    square = spark.range(9).select(F.col("id").alias("shape"), i).selectExpr("shape", "i", "double(i in (1, 2)) as x", "double(i in (2, 3)) as y")
    assert "Broadcast" not in plan(shapes.validity(square))
    assert "Broadcast" not in plan(shapes.inside_crop(square, (0.0, 1.0, 0.0, 1.0)))
    assert shapes.inside_crop(square, (0.0, 1.0, 0.0, 1.0)).count() == 9


def test_squares_around_parts_are_not_broadcast(spark):
    assert "Broadcast" not in plan(QUERIES["j20_overlap_selection_check"](spark, "/root/testdata/sf0.001"))


def test_squares_around_detections_are_not_broadcast(spark):
    det = spark.range(9).selectExpr("'a' as seq", "id as frame", "id as label", "double(id) as x", "0.0d as y")
    assert "Broadcast" not in plan(tracks.candidates(det, 2.0, gap=1))


def test_frames_with_gaps_are_taken_as_they_come(spark):
    rng = random.Random(8)
    det = [(rng.choice("ab"), rng.randrange(12), k, rng.random() * 6, rng.random() * 6) for k in range(150)]
    pairs = tracks.candidates(spark.createDataFrame(det, "seq string, frame long, label long, x double, y double"), 2.0, gap=2)
    assert "FlatMapGroupsInPandas" not in plan(tracks.links(pairs, 2))
    expected, used = set(), {"src": set(), "dst": set()}
    whole = pairs.toPandas().sort_values(["seq", "frame", "step", "src", "dst"])
    for _, part in whole.groupby(["seq", "frame", "step"]):
        part = part[~part["src"].isin(used["src"]) & ~part["dst"].isin(used["dst"])]
        part = part[matching.matched(part["src"].to_numpy(), part["dst"].to_numpy(), part["distance"].to_numpy())]
        for end in used:
            used[end].update(part[end])
        expected |= set(zip(part["src"], part["dst"]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert {(r.src, r.dst) for r in tracks.links(pairs, 2).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_suppression_goes_by_points_not_by_pairs(spark, monkeypatch):
    rng, rows, made = random.Random(9), [], []
    written = tracks.written
    monkeypatch.setattr(tracks, "written", lambda df: made.append(written(df)) or made[-1])
    for k in range(600):  # half of them in one spot at the corner of four blocks, the others over blocks
        rows.append((k, rng.gauss(64, 0.3), rng.gauss(64, 0.3), float(rng.randrange(9))) if k % 2 else (k, rng.uniform(0, 80), rng.uniform(50, 70), float(rng.randrange(9))))
    rows += [(600, None, 1.0, 3.0), (601, 64.0, 64.0, float("nan")), (602, 64.0, 64.0, None)]
    kept = []
    for i, x, y, _ in sorted(rows[:600] + [rows[601]], key=lambda q: (q[3] == q[3], -q[3] if q[3] == q[3] else 0, q[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= 4 for _, a, b in kept):
            kept.append((i, x, y))
    points = spark.createDataFrame(rows, "id long, x double, y double, response double")
    for blocks in ({}, {"squares": 2}):
        assert sorted(r.id for r in tracks.suppress(points, 2.0, **blocks).collect()) == sorted([600, 602] + [k[0] for k in kept])
    assert sum(df.count() for df in made) < 5 * len(rows)


def test_an_audit_reads_the_files_once(spark):
    package = spatial_queries._export(spark, "/root/testdata/sf0.001")
    assert "FileScan csv" not in plan(package.audit())


def test_cycles_are_searched_only_under_edges_back(spark, monkeypatch):
    searched, plans = [], []
    written = tracks.written
    monkeypatch.setattr(tracks, "written", lambda df: plans.append(plan(df)) or written(df))
    for module in (graphs, tracks):  # rounds over a whole sequence
        monkeypatch.setattr(module, "cycle_edges", lambda edges, *_: searched.append(edges.count()) or edges.select("src", "dst"), raising=False)
    det = spark.range(3000).selectExpr("'a' as seq", "id as frame", "id as label", "0.0d as x", "0.0d as y")
    edges = spark.range(2999).selectExpr("id as src", "id + 1 as dst", "0L as gap", "0.0d as cost", "'manual' as origin").union(spark.sql("select 1004L, 1000L, -5L, 0.0d, 'manual'"))
    found = {(r.src, r.dst) for r in tracks.edge_faults(det, edges).collect() if "cycle" in r.reasons.split(",")}
    assert found == {(1000, 1001), (1001, 1002), (1002, 1003), (1003, 1004), (1004, 1000)}
    assert not searched and not any("row_number" in p for p in plans)
