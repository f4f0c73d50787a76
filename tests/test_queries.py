"""Registered queries against their SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from gridquarry.operators import gates, grids, population, sets, studies, tracks
from gridquarry.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9) + 0.0
    try:
        return round(float(v), 9) + 0.0
    except (TypeError, ValueError):
        return str(v)


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    result = duck.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    expected = [tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert ordered(got) == ordered(expected)


def test_a_ring_of_mean_zero_enriches_without_bound(spark, tmp_path):
    # One image: an object in a corner amid zeros, another amid ones.
    duckdb.sql(f"copy (select i as event_id, case when i in (0, 1) then 10.0 when i = 1250 then 30.0 when i // 100 > 9 then 1.0 else 0.0 end as value, 1 as user_id from range(2500) t(i)) to '{tmp_path}/events.parquet'")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    expected = c.execute(ORACLES["a19_ring_enrichment"]).fetchall()
    assert [tuple(r) for r in QUERIES["a19_ring_enrichment"](spark, str(tmp_path)).collect()] == expected == [(0, 2, float("inf"))]


def test_missing_values_sort_last_and_pass_no_filter(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan")), (4, float("inf")), (5, -1.0)], "label long, m double")
    assert [r.label for r in population.page(df, population.ordering("m"), 0, 9).collect()] == [5, 1, 2, 3, 4]
    assert [r.label for r in population.page(df, population.ordering("m", True), 0, 9).collect()] == [1, 5, 2, 3, 4]
    assert population.range_filters(df, {"m": (None, None)}).count() == 2
    assert population.filter_accounting(df, {"m": (0, None)}).first().asDict() == {"total": 5, "selected": 1, "missing_m": 3}


def test_population_of_301(spark):
    df = spark.range(301).selectExpr("1000 + 7 * id as label", "cast(id as double) as m")
    assert population.range_filters(df, {"m": (50, 250)}).count() == 201
    page = population.page(population.range_filters(df, {"m": (50, 250)}), population.ordering("m", True), 190, 20).collect()
    assert [r.m for r in page] == [float(x) for x in range(60, 49, -1)]
    s = population.summary(population.range_filters(df, {"m": (50, 250)}), "m").first()
    assert s["mean"] == s["median"] == 150
    assert sum(r.n for r in population.histogram(df, "m", 8).collect()) == 301
    assert population.even_sample(df, 13).count() == 13


def test_polygon_edges_are_inside(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    points = [(0.0, 0.0), (4.0, 2.0), (2.0, 4.0), (2.0, 2.0), (4.0000001, 2.0), (-1e-9, 1.0), (None, 1.0)]
    df = spark.createDataFrame(points, "x double, y double")
    assert [r.gate for r in gates.polygon_gate(df, "x", "y", square).collect()] == ["inside"] * 4 + ["outside"] * 2 + ["missing"]


def test_log_axis_leaves_out_what_has_no_logarithm(spark):
    df = spark.createDataFrame([(10.0, 1.0), (-1.0, 1.0), (0.0, 1.0), (None, 1.0)], "x double, y double")
    assert [r.gate for r in gates.rectangle_gate(df, "x", "y", (0, 1, 0, 1), log_x=True).collect()] == ["inside", "non_positive", "non_positive", "missing"]


def test_components_of_a_snake(spark):
    picture = ["###..", "..#.#", "###.#", "#....", "#####"]
    rows = [(0, y, x) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"]
    found = grids.components(spark.createDataFrame(rows, "image_id long, y long, x long"), 5, 5).collect()
    assert {(r.y, r.x): r.label for r in found} == {(y, x): (2 if x == 4 and y in (1, 2) else 1) for _, y, x in rows}


def test_one_of_two_objects_missed(spark):
    a = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 1), (0, 0, 3, 2), (0, 0, 4, 0)], "image_id long, y long, x long, label long")
    b = spark.createDataFrame([(0, 0, 0, 9), (0, 0, 1, 9), (0, 0, 3, 0), (0, 0, 4, 0)], "image_id long, y long, x long, label long")
    r = grids.instance_agreement(a, b, 0.5).first()
    assert (r.tp, r.fp, r.fn) == (1, 0, 1) and r.f1 == pytest.approx(2 / 3, abs=1e-6)


def test_hierarchy_weighs_images_and_replicates_equally(spark):
    rows = [("i1", 10.0, "r1"), ("i2", 30.0, "r1"), ("i2", 30.0, "r1"), ("i3", 40.0, "r2"), ("i4", 5.0, None)]
    obs = spark.createDataFrame([(i, v, "reviewed", "A", r) for i, v, r in rows], "image_id string, value double, review string, condition string, replicate string")
    s = studies.condition_summary(obs).first()
    assert (s.replicates, s["mean"]) == (2, 30.0) and s.sd == pytest.approx(200**0.5, abs=1e-4)


def test_group_cycle_is_refused(spark):
    df = spark.range(3).withColumnRenamed("id", "label")
    with pytest.raises(ValueError, match="refers to itself"):
        sets.evaluate("a", {}, {"a": ("union", ["b"]), "b": ("union", ["a"])}, df)


def test_suppression_is_greedy(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.uniform(0, 20), rng.uniform(0, 20), float(rng.randrange(6))) for i in range(150)]
    kept = []
    for i, x, y, _ in sorted(rows, key=lambda q: (-q[3], q[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= 4 for _, a, b in kept):
            kept.append((i, x, y))
    found = tracks.suppress(spark.createDataFrame(rows, "id long, x double, y double, response double"), 2.0)
    assert {r.id for r in found.collect()} == {k[0] for k in kept}


def test_nearest_of_a_lone_point_is_null(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 3.0, 4.0), (3, 1, 7.0, 7.0)], "k long, group long, x double, y double")
    assert {r.k: r.nearest for r in tracks.nearest(df, "k", 0.1).collect()} == {1: 5.0, 2: 5.0, 3: None}


def test_volume_components_and_closing(spark):
    from gridquarry.operators import shapes

    rng = __import__("random").Random(5)
    voxels = {(z, y, x) for z in range(4) for y in range(5) for x in range(5) if rng.random() < 0.35}
    label = {}
    for start in sorted(voxels):
        stack = [start]
        while stack:
            v = stack.pop()
            if v in voxels and v not in label:
                label[v] = (start[0] * 5 + start[1]) * 5 + start[2]
                stack += [(v[0] + a, v[1] + b, v[2] + c) for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    found = shapes.volume_components(spark.createDataFrame(sorted(voxels), "z long, y long, x long"), 5, 5).collect()
    assert {(r.z, r.y, r.x): r.label for r in found} == label


def test_edges_of_a_bow_tie_cross(spark):
    from gridquarry.operators import shapes

    points = {"tie": [(0, 0), (4, 4), (4, 0), (0, 4)], "square": [(0, 0), (4, 0), (4, 4), (0, 4)], "line": [(0, 0), (1, 1)], "twice": [(0, 0), (4, 0), (4, 0), (0, 4)]}
    df = spark.createDataFrame([(s, i, float(x), float(y)) for s, p in points.items() for i, (x, y) in enumerate(p)], "shape string, i long, x double, y double")
    assert {r["shape"]: r.valid for r in shapes.validity(df).collect()} == {"tie": False, "square": True, "line": False, "twice": False}


def test_nearest_boundary_has_no_limit(spark):
    from gridquarry.operators import spatial

    points = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 3, 60), (2, 1, 5, 5), (1, 3, None, 0)], "image_id long, label long, y long, x long")
    boundary = spark.createDataFrame([(1, 3, 64), (1, 90, 70)], "image_id long, y long, x long")
    found = {(r.image_id, r.label): r.distance for r in spatial.nearest_boundary(points, boundary, "label", 12.0).collect()}
    assert found == {(1, 1): (3**2 + 64**2) ** 0.5, (1, 2): 4.0, (2, 1): None, (1, 3): None}
    assert spatial.nearest_boundary(points, boundary.where("false"), "label", 12.0).where("distance is not null").count() == 0
