"""Tile stores, packages, cells, splits, cycles, corrections, samples and
volumes against brute force, with planted faults."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry.functions import typed_cells
from gridquarry.operators import corrections, graphs, sampling, shapes, splits, tracks
from gridquarry.sources import packages, tile_store


# -- tile store ------------------------------------------------------------------


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(i, y, x, float(i * 10_000 + y * 100 + x)) for i, (h, w) in enumerate([(10, 13), (4, 4), (9, 30)]) for y in range(h) for x in range(w)]
    grid = spark.createDataFrame(rows, "image_id long, y long, x long, v double").repartition(3)
    path = str(tmp_path_factory.mktemp("tiles") / "store")
    return rows, tile_store.write(grid, "v", path, size=4, chunk=2)


def test_tiles_are_ragged_at_the_edges_and_verified(store):
    _, s = store
    tiles = {(r.image_id, r.ty, r.tx): (r.h, r.w, r.bytes) for r in s.manifest.collect()}
    assert len(tiles) == 3 * 4 + 1 + 3 * 8 and tiles[0, 2, 3] == (2, 1, 16) and tiles[1, 0, 0] == (4, 4, 128)
    assert {r.verdict for r in s.verified().collect()} == {"ok"}


def test_region_reads_prune_files_and_tiles(spark, store):
    rows, s = store
    read = s.read_region(2, 3, 10, 4, 9)
    assert sorted((r.y, r.x, r.v) for r in read.collect()) == [(y, x, v) for i, y, x, v in rows if i == 2 and 3 <= y < 7 and 10 <= x < 19]
    plan = spark._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    line = next(x for x in plan.split("\n") if "PartitionFilters" in x)
    assert "image_id" in line and "by" in line and "bx" in line
    assert "GreaterThanOrEqual(tx" in plan
    for wrong in [(2, 8, 0, 2, 1), (2, -1, 0, 1, 1), (2, 0, 29, 1, 2), (9, 0, 0, 1, 1), (2, 0, 0, 0, 1)]:
        with pytest.raises(ValueError, match="refused"):
            s.read_region(*wrong)


def test_regions_at_once(spark, store):
    rows, s = store
    asked = [(1, 0, 2, 3, 5, 9), (2, 0, 0, 0, 10, 13), (3, 1, 3, 3, 2, 1), (4, 7, 0, 0, 1, 1), (5, 2, 0, 0, 9, 30)]
    pixels, verdicts = s.read_regions(spark.createDataFrame(asked, "region long, image_id long, y long, x long, h long, w long"))
    assert {r.region: r.refusal for r in verdicts.collect()} == {1: None, 2: None, 3: "outside", 4: "unknown image", 5: None}
    want = sorted((n, y, x, v) for n, i, y0, x0, h, w in asked if n in (1, 2, 5) for j, y, x, v in rows if i == j and y0 <= y < y0 + h and x0 <= x < x0 + w)
    assert sorted((r.region, r.y, r.x, r.v) for r in pixels.collect()) == want


def test_large_regions_are_refused(spark, tmp_path):
    s = tile_store.write(spark.createDataFrame([(0, 0, 0, 1.0)], "image_id long, y long, x long, v double"), "v", str(tmp_path / "s"), 4, 1)
    big = spark.createDataFrame([(0, 0, 3000, 3000, 4000, 4000)], "y long, x long, h long, w long, height long, width long")
    assert big.select(s._refusal().alias("r")).first().r == "too large"  # 3000 * 3000 * 8 bytes


@pytest.mark.parametrize("rows,reason", [([(0, 0), (0, 1), (1, 0)], "ragged"), ([(0, 0), (0, 0)], "duplicate"), ([(0, 0), (0, 9)], "ragged|missing tile"), ([(-1, 0), (0, 0)], "outside")])
def test_faulty_images_are_not_stored(spark, tmp_path, rows, reason):
    grid = spark.createDataFrame([(5, y, x, 1.0) for y, x in rows], "image_id long, y long, x long, v double")
    with pytest.raises(ValueError, match=reason):
        tile_store.write(grid, "v", str(tmp_path / "s"), 4, 1)
    assert not (tmp_path / "s").exists()


def test_changed_tiles_are_found(spark, tmp_path):
    grid = spark.createDataFrame([(0, y, x, 1.0) for y in range(8) for x in range(8)], "image_id long, y long, x long, v double")
    s = tile_store.write(grid, "v", str(tmp_path / "s"), 4, 1)
    other = s.tiles.where("tx = 0").withColumn("values", F.transform("values", lambda v: v + 1)).collect()
    spark.createDataFrame(other, s.tiles.schema).where("ty = 0 and tx = 0").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image_id", "by", "bx").parquet(f"{s.path}/tiles")
    assert {(r.ty, r.tx): r.verdict for r in s.verified().collect()} == {(0, 0): "checksum", (0, 1): "ok", (1, 0): "ok", (1, 1): "ok"}


# -- splits ----------------------------------------------------------------------


def test_split_rules(spark):
    rules = spark.createDataFrame([("train", "A/b"), ("test", "a/b/c/"), ("train", "./x//Y"), ("train", "x/y"), ("test", "q")] + [("train", f"many/{i}") for i in range(5000)], "split string, prefix string")
    paths = ["a/B/f.tif", "a/b/c/g", "a/bc/f", "X/./y/z", "x/y", "Q", None, "/q/a", "q/../r", "c:/q", "q\\a", "many/4999/f", "many/5000/f", "", "q//./a"]
    found = {r.path_id: (r.split, r.rule, r.splits) for r in splits.assign_splits(spark.createDataFrame(list(enumerate(paths)), "path_id long, path string"), rules, "path_id").collect()}
    assert found == {
        0: ("train", "a/b", ["train"]), 1: (None, "a/b/c", ["test", "train"]), 2: ("unassigned", None, []), 3: ("train", "x/y", ["train"]), 4: ("train", "x/y", ["train"]), 5: ("test", "q", ["test"]), 6: ("refused", None, []), 7: ("refused", None, []),
        8: ("refused", None, []), 9: ("refused", None, []), 10: ("refused", None, []), 11: ("train", "many/4999", ["train"]), 12: ("unassigned", None, []), 13: ("refused", None, []), 14: ("test", "q", ["test"]),
    }
    assert {r.split for r in splits.assign_splits(spark.createDataFrame([(1, "a")], "k long, path string"), rules.where("false"), "k").collect()} == {"unassigned"}


def test_leaks_go_over_several_links(spark):
    rows = [(1, "train", "h1", "g1"), (2, "train", "h2", "g1"), (3, "test", "h2", "g2"), (4, "test", "h4", "g3"), (5, "test", "h5", "g3"), (6, "train", None, None), (7, "test", None, None), (8, "train", "h8", "g8"), (8, "test", "h9", "g8")]
    df = spark.createDataFrame(rows, "id long, split string, hash string, grp string")
    found = splits.leaks(df, "id", "split", {"hash": F.col("hash"), "group": F.col("grp"), "id": F.col("id")}).collect()
    assert sorted((r.component, r.records, r.splits, r.repeated) for r in found) == [(1, 3, "test,train", "group,hash"), (8, 2, "test,train", "group,id")]


# -- cells -----------------------------------------------------------------------


def test_numbers_are_written_shortest_and_read_back(spark):
    rng = random.Random(4)
    values = [0.1, 1.0, -0.0, 100.0, 1e16, 2e-3, 2.0**-44, 9007199254740993.0, 1.7976931348623157e308, 5e-324, 1 / 3, 0.3, 123456789.12345679] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-20, 20) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", typed_cells.encode_as(F.col("v"), "number").alias("c"))
    for r in df.collect():
        digits = lambda t: len(t.lower().split("e")[0].replace(".", "").lstrip("-").strip("0"))
        assert float(r.c) == r.v and digits(r.c) <= max(digits(repr(r.v)), 1), (r.v, r.c)


def test_cells_of_all_types_round_trip(spark):
    kinds = {"s": "string", "b": "boolean", "i": "integer", "n": "number"}
    rows = [(1, "=1+1", True, 5, 0.1), (2, None, None, None, None), (3, "\\N", False, -(2**63), -0.0), (4, "'x\\y\n", True, 2**63 - 1, 1e300), (5, "", False, 0, float("nan")), (6, "  -a", True, 1, float("inf"))]
    df = spark.createDataFrame(rows, "k long, s string, b boolean, i long, n double")
    coded = typed_cells.encoded(df, kinds)
    assert {r.k: r.rejects for r in coded.collect() if r.rejects} == {5: ["n"], 6: ["n"]}
    back = {r.k: (r.s, r.b, r.i, r.n, r.rejects) for r in typed_cells.decoded(coded.drop("rejects"), kinds).collect()}
    assert {k: v[:3] for k, v in back.items()} == {r[0]: r[1:4] for r in rows} and back[1][3] == 0.1 and back[4][3] == 1e300 and back[5][3:] == (None, ["n"])
    bad = spark.createDataFrame([(1, "a\\b", "True", "01", "1e999"), (2, "a", "false", "1.0", ".5"), (3, "a", "\\N", "99999999999999999999", "-0")], "k long, s string, b string, i string, n string")
    assert {r.k: r.rejects for r in typed_cells.decoded(bad, kinds).collect()} == {1: ["s", "b", "i", "n"], 2: ["i", "n"], 3: ["i"]}


def test_nested_rows_become_wide(spark):
    df = spark.createDataFrame([(1, (2, [(3,), (4,)]), {"k": [5]}), (2, None, None)], "a long, s struct<x:long,l:array<struct<y:long>>>, m map<string,array<long>>")
    flat = typed_cells.flattened(df)
    assert flat.columns == ["a", "s:x", "s:l:0:y", "s:l:1:y", "m:k:0"]
    assert {tuple(r) for r in flat.collect()} == {(1, 2, 3, 4, 5), (2, None, None, None, None)}


def test_linear_maps(spark):
    g = typed_cells.Geometry([[0, -2, 0, 5], [3, 0, 0, 6], [0, 0, 4, 7], [0, 0, 0, 1]], "ZYX")
    assert g.spacing() == [4, 2, 3]
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "z double, y double, x double")
    w = df.select("*", *(c.alias(f"w{a}") for a, c in zip("xyz", g.world([F.col(a) for a in "zyx"])))).first()
    assert (w.wx, w.wy, w.wz) == (1, 15, 11)
    c = g.cropped([1, 2, 3])
    assert [r[3] for r in c.affine[:3]] == [1, 15, 11]
    back = df.select(*(v.alias(a) for a, v in zip("zyx", g.index([F.lit(1.0), F.lit(15.0), F.lit(11.0)])))).first()
    assert tuple(back) == pytest.approx((1, 2, 3))
    for wrong in ([[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 1, 1]]):
        with pytest.raises(ValueError):
            typed_cells.Geometry(wrong, "YX")
    rgb = np.array([[10, 200, 30], [255, 255, 255], [0, 1, 254]], dtype=float)
    basis = np.array(typed_cells.HAEMATOXYLIN_DAB + [np.cross(*typed_cells.HAEMATOXYLIN_DAB)])
    want = np.maximum(np.log(np.maximum(rgb / 255, 1e-6)) / np.log(1e-6) @ np.linalg.inv(basis), 0)
    df = spark.createDataFrame(rgb.tolist() + [[256.0, 0.0, 0.0]], "r double, g double, b double")
    got = [tuple(r) for r in df.select(*typed_cells.stains([F.col(c) for c in "rgb"], typed_cells.HAEMATOXYLIN_DAB)).collect()]
    assert np.allclose(got[:3], want) and got[3] == (None, None, None)


# -- packages --------------------------------------------------------------------


@pytest.fixture(scope="module")
def package(spark, tmp_path_factory):
    rows = [(f"r{i % 2}", "1", f"s{i % 2}", i + 1, i / 3, "a,\"b\n=", i % 2 == 0, "reviewed", "st", "", "c", None if i % 2 else "rep", float(i), None if i % 3 else 1.5, f"g{i % 4}") for i in range(20)]
    o = spark.createDataFrame(rows, "result_id string, revision string, source_id string, label long, measure double, unit string, touches_border boolean, review string, study string, sample string, condition string, biological_replicate string, m1 double, m2 double, grp string")
    tables, records = packages.from_objects(o, {"m1": "integer", "m2": "float"}, F.expr("label > 4"), "grp")
    return rows, tables, records, packages.write(tables, records, str(tmp_path_factory.mktemp("p") / "package"), "reviewed")


def test_packages_read_back_and_hold(spark, package, tmp_path):
    rows, tables, records, p = package
    for name in packages.TABLES:
        columns = list(packages.TABLES[name])
        assert sorted(map(str, p.table(name).select(*columns).collect())) == sorted(map(str, tables[name].select(*columns).collect())), name
    assert {r.verdict for r in p.verified().collect()} == {"ok"} and p.audit().where("faults > 0").collect() == []
    assert p.records().count() == 16
    with pytest.raises(ValueError, match="taken"):
        packages.write(tables, records, p.path)
    with pytest.raises(ValueError, match="objects has values without a cell in measure"):
        packages.write(tables | {"objects": tables["objects"].withColumn("measure", F.lit(float("nan")))}, records, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_planted_faults_of_each_relation_are_found(spark, package):
    _, _, _, p = package
    held = {name: p.table(name) for name in packages.TABLES}
    put = lambda name, column, value: {name: held[name].withColumn(column, F.when(F.col("result_id") == "r0" if "result_id" in held[name].columns else F.col("source_id") == "s0", F.expr(value)).otherwise(F.col(column)))}
    faults = {
        "objects of a result": put("results", "selected_count", "selected_count + 1"), "measurements of a result": put("results", "measurement_count", "0"), "total of a result": put("results", "total_count", "1"), "objects without results": put("objects", "revision", "'9'"),
        "measurements without objects": put("measurements", "label", "label + 100"), "groups without results": put("groups", "result_id", "'rx'"), "memberships without groups": put("memberships", "group_id", "'gx'"), "memberships without objects": put("memberships", "label", "label + 100"),
        "range of labels": put("objects", "label", "0"), "status of measurements": put("measurements", "status", "'missing'"), "source of groups": put("groups", "source_id", "'s9'"), "total of groups": put("groups", "total_count", "0"), "exported of groups": put("groups", "exported_count", "99"),
        "included of groups": put("groups", "included_count", "0"), "revision of memberships": put("memberships", "revision", "'0'"), "records of objects": {"objects": held["objects"].where("label <> 7")}, "source of samples": put("samples", "source_id", "'s9'"), "review of results": put("results", "review", "'pending'"),
        "sums of the manifest": put("samples", "biological_replicate", "null"), "key of results": {"results": held["results"].union(held["results"])}, "key of samples": put("samples", "source_id", "''"), "key of memberships": {"memberships": held["memberships"].union(held["memberships"])},
    }
    found = {r.check for r in p.audit().collect()}
    assert set(faults) <= found
    for check, change in faults.items():
        assert packages.audit(held | change, p.records(), p.stated(), [check]).first().faults > 0, check


# -- cycles ----------------------------------------------------------------------


def brute_cycles(edges):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)

    def reached(a):
        seen, stack = set(), list(ahead.get(a, ()))
        while stack:
            v = stack.pop()
            if v not in seen:
                seen.add(v)
                stack += ahead.get(v, ())
        return seen

    reach = {a: reached(a) for a in ahead}
    return {(a, b) for a, b in edges if a == b or a in reach.get(b, ())}


@pytest.mark.parametrize("small", [0, 10**6])
def test_edges_of_cycles(spark, small):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 23) for i in range(23)] + [(60, 100), (100, 300), (7, 7), (300, 301), (301, 302), (302, 300), (301, 400)]
    edges += [(1000 + rng.randrange(14), 1000 + rng.randrange(14)) for _ in range(18)]
    found = graphs.cycle_edges(spark.createDataFrame(edges, "src long, dst long"), small)
    assert {(r.src, r.dst) for r in found.collect()} == brute_cycles(edges)


def test_stretches_under_edges_back(spark):
    rng = random.Random(4)
    spans = [(3, 3), (5, 8), (8, 9), (10, 10), (10, 14), (40, 61), (62, 63)] + [(a, a + rng.randrange(5)) for a in rng.sample(range(70, 160), 30)]
    covered = {i for a, b in spans for i in range(a, b + 1)}
    expected, part = {}, 0
    for i in sorted(covered):
        part += not any(a < i <= b for a, b in spans)
        expected.setdefault(part, set()).add(i)
    for block in (1, 4, 1000):
        found = {}
        rows = tracks.stretches(spark.createDataFrame(spans, "early long, late long"), block).collect()
        for r in rows:
            found.setdefault(r.part, set()).add(r._i)
        assert len(rows) == len(covered) and sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("small", [15, 10**6])
def test_cycles_and_gaps_of_track_edges(spark, small):
    rng = random.Random(11)
    det = [(rng.choice("ab"), rng.randrange(300) * 3, k, 0.0, 0.0) for k in range(900)]
    frame, seq = {k: f for _, f, k, _, _ in det}, {k: s for s, _, k, _, _ in det}
    order = {s: sorted({f for z, f, *_ in det if z == s}) for s in "ab"}
    inside = {s: sorted((k for k in seq if seq[k] == s), key=lambda k: (frame[k], k)) for s in "ab"}
    edges = {(4, 4), (5, 900), tuple(inside["a"][:1] + inside["b"][:1])}
    for nodes in inside.values():
        for i in range(len(nodes) - 8):
            edges |= {(nodes[i], nodes[i + rng.randrange(1, 4)]) for _ in "12"}
            if rng.random() < 0.06:
                edges.add((nodes[i + rng.randrange(1, 9)], nodes[i]))
    rows = [(a, b, rng.randrange(3), 0.0, "manual") for a, b in sorted(edges)]
    same = {(a, b) for a, b in edges if seq.get(a) == seq.get(b)}
    cyclic = brute_cycles(same)
    assert 50 < len(cyclic) < len(edges) / 2
    wrong = {(a, b) for a, b, gap, *_ in rows if (a, b) in same and gap != order[seq[a]].index(frame[b]) - order[seq[a]].index(frame[a]) - 1}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = tracks.edge_faults(spark.createDataFrame(det, "seq string, frame long, label long, x double, y double"), spark.createDataFrame(rows, "src long, dst long, gap long, cost double, origin string"), small).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    told = {name: {(r.src, r.dst) for r in found if name in r.reasons.split(",")} for name in ("cycle", "gap", "unknown")}
    assert told == {"cycle": cyclic, "gap": wrong, "unknown": edges - same}


# -- corrections -----------------------------------------------------------------


def correct(spark, picture, operations):
    rows = [(i, y, x, int(c)) for i, lines in enumerate(picture) for y, line in enumerate(lines) for x, c in enumerate(line)]
    full = [(i, s, op, lab, labs, [{"x": float(x), "y": float(y)} for x, y in pts] if pts else None, rad) for i, s, op, lab, labs, pts, rad in operations]
    schema = "image_id long, seq long, op string, label long, labels array<long>, points array<struct<x:double,y:double>>, radius double"
    after, verdicts = corrections.correct_labels(spark.createDataFrame(rows, "image_id long, y long, x long, label long"), spark.createDataFrame(full, schema), len(picture[0][0]), len(picture[0]))
    out = {}
    for r in after.collect():
        out[r.image_id, r.y, r.x] = r.label
    pictures = ["/".join("".join(str(out[i, y, x]) for x in range(len(picture[0][0]))) for y in range(len(picture[0]))) for i in range(len(picture))]
    return pictures, {(r.image_id, r.seq): (r.verdict, r.changed) for r in verdicts.collect()}


def test_corrections_go_in_order(spark):
    square = ["11022", "11022", "00000", "33044"]
    plan = [(0, 1, "merge", 1, [1, 2], None, None), (0, 2, "delete", 3, None, None, None), (0, 3, "paint", 1, None, [(2, 0), (2, 1)], 0.5), (0, 4, "polygon_add", 7, None, [(0, 2), (1, 2), (1, 3), (0, 3)], None), (0, 5, "erase", 7, None, [(0, 3)], 0.5), (0, 6, "polygon_replace", 4, None, [(3, 2), (4, 2), (4, 3), (3, 3)], None)]
    (after,), verdicts = correct(spark, [square], plan)
    assert after == "11111/11111/77044/07044"
    assert verdicts == {(0, 1): ("ok", 4), (0, 2): ("ok", 2), (0, 3): ("ok", 2), (0, 4): ("ok", 4), (0, 5): ("ok", 1), (0, 6): ("ok", 2)}


def test_refused_corrections_leave_the_image(spark):
    square = ["11022", "11022", "00000", "33044"]
    wrong = [
        ("paint", 5, None, [(0, 0)], 0.5, "collision"), ("paint", 1, None, [(0, 0)], 0.5, "no-op"), ("erase", 1, None, [(2, 2)], 0.2, "no-op"), ("erase", 1, None, [(3, 0)], 0.5, "collision"), ("polygon_add", 4, None, [(1, 2), (3, 2), (2, 2)], None, "label in use"), ("polygon_add", 9, None, [(0, 0), (1, 0), (1, 1)], None, "collision"),
        ("polygon_replace", 9, None, [(0, 0), (1, 0), (1, 1)], None, "absent"), ("polygon_replace", 3, None, [(2, 2), (2, 3), (2, 1)], None, "no overlap"), ("polygon_replace", 3, None, [(0, 3), (0, 1), (1, 3)], None, "collision"), ("polygon_replace", 1, None, [(0, 0), (1, 0), (1, 1), (0, 1)], None, "no-op"),
        ("merge", 1, [1, 9], None, None, "absent"), ("merge", 1, [1], None, None, "invalid"), ("merge", 2, [1, 3], None, None, "invalid"), ("delete", 9, None, None, None, "absent"), ("resize", 1, None, None, None, "invalid"), ("paint", 0, None, [(2, 2)], 0.5, "invalid"), ("paint", 6, None, None, 0.5, "invalid"),
    ]
    plan = []
    for i, (op, label, labels, points, radius, _) in enumerate(wrong):
        plan += [(i, 1, "delete", 4 if not (op == "polygon_add" and label == 4) else 3, None, None, None), (i, 2, op, label, labels, points, radius), (i, 3, "delete", 2, None, None, None)]
    pictures, verdicts = correct(spark, [square] * len(wrong), plan)
    assert set(pictures) == {"/".join(square)}
    assert {i: verdicts[i, 2] for i in range(len(wrong))} == {i: (w[-1], 0) for i, w in enumerate(wrong)}
    assert {verdicts[i, 3] for i in range(len(wrong))} == {("not reached", 0)}


def test_a_label_in_two_parts_is_not_replaced(spark):
    (after,), verdicts = correct(spark, [["10010", "00000"]], [(0, 1, "polygon_replace", 1, None, [(0, 0), (0, 1), (1, 1)], None)])
    assert after == "10010/00000" and verdicts == {(0, 1): ("several parts", 0)}


# -- samples, neighbours, volumes -------------------------------------------------


def test_weighted_samples_and_patches(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(2000)], "k long, w double")
    one = {r.k for r in sampling.weighted_sample(df, "k", "w", 500, 1).collect()}
    assert len(one) == 500 and one == {r.k for r in sampling.weighted_sample(df.repartition(7), "k", "w", 500, 1).collect()} and all(k % 5 for k in one)
    share = [sum(k % 5 == m for k in one) for m in range(5)]
    assert share[1] < share[2] < share[4] and abs(share[4] / share[1] - 4) < 2.5
    assert sampling.weighted_sample(df, "k", "w", 10**6, 1).count() == 1600
    images = spark.createDataFrame([(1, 10, 30, 1.0), (2, 40, 8, 3.0), (3, 50, 50, 0.0), (4, 50, 50, None)], "image_id long, height long, width long, weight double")
    objects = spark.createDataFrame([(1, 5, 2.0, 25.0), (1, 6, 9.0, 3.0)], "image_id long, label long, y double, x double")
    got = sampling.drawn_patches(images, objects, 2000, 8, 0.5, seed=2).collect()
    assert len(got) == 2000 and {r.image_id for r in got} == {1, 2} and abs(sum(r.image_id == 2 for r in got) - 1500) < 100
    assert all(0 <= r.y <= (2 if r.image_id == 1 else 32) and 0 <= r.x <= (22 if r.image_id == 1 else 0) for r in got)
    aimed = [r for r in got if r.label is not None]
    assert {(r.label, r.y, r.x) for r in aimed} == {(5, 0, 21), (6, 2, 0)} and abs(len(aimed) - sum(r.image_id == 1 for r in got) / 2) < 60
    assert sampling.drawn_patches(images.where("weight = 0"), objects, 10, 8, 0.5).collect() == []
    covered = {}
    for r in sampling.coverage(images, 8).collect():
        covered.setdefault(r.image_id, []).append((r.y, r.x))
    assert sorted(covered[1]) == [(y, x) for y in (0, 2) for x in (0, 8, 16, 22)] and sorted(covered[2]) == [(y, 0) for y in (0, 8, 16, 24, 32)]


def test_remeasuring_equals_measuring_anew(spark):
    rng = random.Random(6)
    rows = [(i, i % 3, rng.uniform(0, 40), rng.uniform(0, 40)) for i in range(240)] + [(500, 9, 1.0, 1.0), (501, 9, 2.0, 1.0)]
    points = spark.createDataFrame(rows, "key long, group long, x double, y double")
    measured = tracks.nearest_neighbours(points, points, "key", 1.0)
    gone = {r[0] for r in rows if r[0] % 6 == 1} | {501}
    found = tracks.remeasured(points, measured, spark.createDataFrame([(k,) for k in gone], "key long"), "key", 1.0)
    left = [r for r in rows if r[0] not in gone]
    want = {}
    for k, g, x, y in left:
        near = [(math.sqrt((x - c) ** 2 + (y - d) ** 2), o) for o, h, c, d in left if h == g and o != k]
        want[k] = min(near) if near else (None, None)
    assert {r.key: (r.nearest, r.neighbour) for r in found.collect()} == want


def test_volume_morphometrics(spark):
    rng = random.Random(3)
    things = {1: [(0, 0, 0)], 2: [(0, 5, x) for x in range(4)], 3: [(i, i, i + 20) for i in range(3)], 4: [(2, y, x) for y in range(10, 14) for x in range(10, 15)], 5: [(z, y, x) for z in range(3) for y in range(20, 23) for x in range(20, 24)], 6: [(z, y, x) for z in range(4) for y in range(30, 35) for x in range(30, 36) if rng.random() < 0.6]}
    df = spark.createDataFrame([(1, *p, label) for label, ps in things.items() for p in ps] + [(1, 9, 9, 9, 0)], "volume_id long, z long, y long, x long, label long")
    spacing = np.array([2.0, 0.5, 0.25])
    for r in shapes.volume_morphometrics(df, tuple(spacing)).collect():
        ps = things[r.label]
        world = np.array(ps) * spacing
        values = np.sort(np.linalg.eigvalsh(np.cov(world.T, bias=True)) if len(ps) > 1 else np.zeros(3))[::-1]
        assert np.allclose([r.major, r.middle, r.minor], np.maximum(values, 0), atol=2e-5)
        area = [spacing[1] * spacing[2], spacing[0] * spacing[2], spacing[0] * spacing[1]]
        surface = sum(area[a] for p in ps for a in range(3) for s in (-1, 1) if tuple(v + s * (a == b) for b, v in enumerate(p)) not in ps)
        assert r.surface == pytest.approx(surface) and r.volume == pytest.approx(len(ps) * 0.25)
        assert r.reason == {1: "one voxel", 2: "voxels on a line", 3: "voxels on a line", 4: "voxels in a plane"}.get(r.label, "")
        assert (r.sphericity is None) == (r.label == 1) and (r.elongation is None) == (r.label <= 3)
