"""Operators against brute force and hand-written cases."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry.functions import cells
from gridquarry.operators import declared, filters, grids, matching, population, shapes, sheets, spatial, tracks


def components(cells, steps, same=lambda a, b: True):
    """The least cell that each cell reaches."""
    label = {}
    for start in sorted(cells):
        stack = [start]
        while stack:
            c = stack.pop()
            if c in label:
                continue
            label[c] = start
            stack += [d for s in steps for d in [tuple(a + b for a, b in zip(c, s))] if d in cells and d not in label and same(c, d)]
    return label


@pytest.mark.parametrize("tile", [2, 3, 4, 16])
def test_components_dont_depend_on_tiles(spark, tile):
    rng = random.Random(tile)
    cells = {(i, y, x): rng.randrange(2) for i in range(2) for y in range(11) for x in range(13) if rng.random() < 0.6}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "image_id long, y long, x long, k long")
    near4 = [(0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    near8 = [(0, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    for expected, found in (
        (components(cells, near4), grids.components(df, 13, 11, tile=tile)),
        (components(cells, near8, lambda a, b: cells[a] == cells[b]), grids.components(df, 13, 11, "k", diagonal=True, tile=tile)),
    ):
        number = {}
        for i in range(2):
            number |= {root: n for n, root in enumerate(sorted({r for c, r in expected.items() if c[0] == i}), 1)}
        assert {(r.image_id, r.y, r.x): r.label for r in found.collect()} == {c: number[r] for c, r in expected.items()}


@pytest.mark.parametrize("block", [2, 3, 32])
def test_volume_components_dont_depend_on_blocks(spark, block):
    rng = random.Random(block)
    voxels = {(z, y, x) for z in range(5) for y in range(6) for x in range(7) if rng.random() < 0.4}
    steps = [tuple(s * (i == j) for j in range(3)) for i in range(3) for s in (1, -1)]
    expected = {c: (r[0] * 6 + r[1]) * 7 + r[2] for c, r in components(voxels, steps).items()}
    found = shapes.volume_components(spark.createDataFrame(sorted(voxels), "z long, y long, x long"), 7, 6, block)
    assert {(r.z, r.y, r.x): r.label for r in found.collect()} == expected


def test_plateaus_have_one_first_pixel(spark):
    picture = ["3.3..", "3.3.1", "333..", ".....", "2.2.5"]
    rows = [(0, y, x, float(c) if c != "." else 0.0) for y, line in enumerate(picture) for x, c in enumerate(line)]
    found = spatial.plateau_maxima(spark.createDataFrame(rows, "image_id long, y long, x long, v double"), "v", 5, 5)
    assert {(r.y, r.x) for r in found.where("v > 0").collect()} == {(0, 0), (1, 4), (4, 0), (4, 2), (4, 4)}


def test_polygons_need_an_area_and_edges_that_dont_fold_back(spark):
    points = {
        "line": [(0, 0), (1, 1), (2, 2)],
        "triangle": [(0, 0), (4, 0), (0, 4)],
        "spike": [(0, 0), (4, 0), (4, 4), (4, 2), (0, 4)],
        "flat vertex": [(0, 0), (2, 0), (4, 0), (4, 4)],
        "many": [(np.cos(i / 65 * 2 * np.pi), np.sin(i / 65 * 2 * np.pi)) for i in range(65)],
        "most": [(np.cos(i / 64 * 2 * np.pi), np.sin(i / 64 * 2 * np.pi)) for i in range(64)],
    }
    df = spark.createDataFrame([(s, i, float(x), float(y)) for s, p in points.items() for i, (x, y) in enumerate(p)], "shape string, i long, x double, y double")
    assert {r["shape"]: r.valid for r in shapes.validity(df).collect()} == {"line": False, "triangle": True, "spike": False, "flat vertex": True, "many": False, "most": True}


def test_tiled_deviations_survive_a_large_mean(spark):
    rng = random.Random(1)
    rows = [(0, y, x, 1, 1e8 + rng.randrange(2), 1e8 + rng.random()) for y in range(8) for x in range(8)]
    r = grids.tiled_measures(spark.createDataFrame(rows, "image_id long, y long, x long, label long, v double, w double"), "v", 3, "w").first()
    v, w = np.array([q[4] for q in rows]), np.array([q[5] for q in rows])
    assert r.pixels == 64 and r.sd == pytest.approx(v.std(), abs=1e-5) and r.covariance == pytest.approx(((v - v.mean()) * (w - w.mean())).mean(), abs=1e-5)


def test_chains_refuse_cycles_branches_and_merges(spark):
    nodes = spark.range(6).withColumnRenamed("id", "node")
    run = lambda *e: {r.node: (r.track, r.depth) for r in tracks.chains(nodes, spark.createDataFrame(e, "src long, dst long")).collect()}
    assert run((1, 3), (3, 2), (4, 5)) == {0: (0, 0), 1: (1, 0), 3: (1, 1), 2: (1, 2), 4: (4, 0), 5: (4, 1)}
    for wrong in ([(1, 2), (2, 3), (3, 1)], [(1, 2), (1, 3)], [(1, 3), (2, 3)]):
        with pytest.raises(ValueError):
            run(*wrong)


def best(pairs):
    """Most pairs, then least cost, by trying all subsets."""
    ends = sorted({a for a, _ in pairs})
    top = (0, 0.0)
    for choice in itertools.product(*([None] + [b for x, b in pairs if x == a] for a in ends)):
        taken = [(a, b) for a, b in zip(ends, choice) if b is not None]
        if len({b for _, b in taken}) == len(taken):
            top = min(top, (-len(taken), sum(pairs[t] for t in taken)))
    return top


def test_matching_is_the_best(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for g in range(60):
        pairs = {(a, b): rng.choice([0.5, 1.0, rng.random() * 9]) for a in range(rng.randrange(1, 6)) for b in range(rng.randrange(1, 6)) if rng.random() < 0.5}
        rows += [(g, a, b, c) for (a, b), c in pairs.items()]
        expected |= {g: best(pairs)} if pairs else {}
    df = spark.createDataFrame(rows, "g long, a long, b long, c double")
    found = matching.best_matching(df, ["g"], "a", "b", "c").groupBy("g").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).collect()
    assert {r.g: (-r.n, pytest.approx(r.c)) for r in found} == expected and all(r.a == r.b == r.n for r in found)


def test_tracking_takes_the_least_total_distance(spark):
    det = spark.createDataFrame([("s", 0, 1, 0.0, 0.0), ("s", 0, 2, 1.1, 0.0), ("s", 1, 3, 1.0, 0.0), ("s", 1, 4, 2.2, 0.0), ("s", 2, 5, 2.2, 0.1)], "seq string, frame long, label long, x double, y double")
    found = tracks.links(tracks.candidates(det, 1.5))
    assert {(r.src, r.dst) for r in found.collect()} == {(1, 3), (2, 4), (4, 5)}


def test_tracking_over_gaps(spark):
    # 1 has nothing in frame 1 and is found again in frame 2, before frame 1's own detection.
    det = spark.createDataFrame([("s", 0, 1, 0.0, 0.0), ("s", 1, 2, 9.0, 0.0), ("s", 2, 3, 0.1, 0.0), ("s", 2, 4, 9.1, 0.0), ("s", 1, 5, 0.9, 2.0)], "seq string, frame long, label long, x double, y double")
    pairs = tracks.candidates(det, 2.2, gap=1)
    assert {(r.src, r.dst, r.step) for r in tracks.links(pairs, 1).collect()} == {(1, 5, 1), (5, 3, 1), (2, 4, 1)}
    near = tracks.candidates(det, 1.0, gap=1)
    assert {(r.src, r.dst, r.step) for r in tracks.links(near, 1).collect()} == {(1, 3, 2), (2, 4, 1)}
    a = {(r.src, r.dst): (r.by_source, r.by_target, r.ambiguous) for r in tracks.ambiguity(pairs, tracks.links(pairs, 1), 5.0).collect()}
    assert a == {(1, 5): (0, 0, False), (5, 3): (0, 0, False), (2, 4): (0, 0, False)}


def test_low_thresholds_are_matched(spark):
    # One object covers two: the pair with the larger overlap is kept, the other counts as missed and as a merge.
    a = [(0, 0, x, 1 if x < 4 else 2) for x in range(6)]
    b = [(0, 0, x, 9) for x in range(6)]
    kind = "image_id long, y long, x long, label long"
    r = grids.instance_agreement(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 0.2).first()
    assert (r.tp, r.fp, r.fn, r.splits, r.merges, r.missed, r.surplus, r.count_error) == (1, 0, 1, 0, 1, "2", "", -1)
    assert r.mean_iou == pytest.approx(4 / 6, abs=1e-6)


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), float(rng.randrange(9)), rng.random()])) for _ in range(300)] + [("lone", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, m double")
    found = {r.g: (r.q0, r.q1) for r in population.quantiles(df, "m", [0.5, 0.99], "g").collect()}
    values = {g: [m for h, m in rows if h == g and m is not None and m == m] for g in ("a", "b", None, "lone")}
    assert found == {g: (pytest.approx(np.quantile(v, 0.5)), pytest.approx(np.quantile(v, 0.99))) for g, v in values.items()}
    one = population.quantiles(df, "m", [0.25]).first()
    assert one.q0 == pytest.approx(np.quantile(sum(values.values(), []), 0.25))
    s = {r.g: (r.n, r.missing, r["median"]) for r in population.summary(df, "m", "g").collect()}
    assert s["lone"] == (1, 0, 3.5) and s["none"] == (0, 1, None) and s[None][0] == len(values[None])
    assert population.quantiles(df.where("false"), "m", [0.5]).first().q0 is None


def test_whole_population_query(spark):
    df = spark.range(301).selectExpr("1000 + 7 * id as label", "cast(id as double) as m", "if(id % 10 = 0, null, cast(id as double)) as s")
    rows = population.population_query(df, {"m": (50.0, 250.0)}, "m", "s", 1000 + 7 * 61, descending=True, offset=5, limit=4, sample=3).collect()
    part = lambda p: [(r.place, r.name, r.label, r.value) for r in rows if r.part == p]
    assert {n: v for _, n, _, v in part("filters")} == {"total": 301, "selected": 201, "missing_m": 0}
    assert {n: v for _, n, _, v in part("summary")}["median"] == 150
    assert sum(v for _, n, _, v in part("histogram") if n == "n") == 201
    assert sorted(part("page")) == [(5, "s", 1000 + 7 * 244, 244.0), (6, "s", 1000 + 7 * 243, 243.0), (7, "s", 1000 + 7 * 242, 242.0), (8, "s", 1000 + 7 * 241, 241.0)]
    assert part("rank") == [(170, "", 1000 + 7 * 61, None)]
    assert sorted(part("sample")) == [(0, "m", 1350, 50.0), (100, "m", 2050, 150.0), (200, "m", 2750, 250.0)]
    assert len(part("members")) == 1


def test_byte_pages_take_rows_of_no_size(spark):
    sizes = [0, 0, 5, 0, 4, 0, 0, 3, 9, 0, 1] + [0] * 3000
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, size long")
    offset, pages = 0, []
    while offset < len(sizes):
        page = cells.byte_page(df, "k", "size", 8, offset).collect()
        pages.append([r.k for r in page])
        assert {r.next_offset for r in page} == {offset + len(page)}
        offset += len(page)
    assert pages[:4] == [[0, 1, 2, 3], [4, 5, 6, 7], [8], list(range(9, len(sizes)))] and sum(pages, []) == list(range(len(sizes)))


def test_cells_come_back(spark):
    texts = ["=1", "'=1", " -x", "a\\b", "\\N", "", None, "'", "''=x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.d for r in df.select(cells.decode(cells.encode(F.col("t")).alias("e")).alias("d")).collect()] == texts
    exact = spark.createDataFrame([("1.5e300",), ("12345678901234567e-5",), ("123456789012345678",)], "t string")
    assert [r.e for r in exact.select(cells.is_exact(F.col("t")).alias("e")).collect()] == [True, True, False]


def mirrored(a, y, x):
    h, w = a.shape
    y, x = y % (2 * h), x % (2 * w)
    return a[y if y < h else 2 * h - 1 - y, x if x < w else 2 * w - 1 - x]


def by_force(a, op, size):
    """A filter pixel by pixel, over a mirrored picture."""
    h, w = a.shape
    reach = range(-int(size), int(size) + 1)
    foot = [(dy, dx) for dy in reach for dx in reach if dy * dy + dx * dx <= size * size]
    over = lambda b, how: np.array([[how([mirrored(b, y + dy, x + dx) for dy, dx in foot]) for x in range(w)] for y in range(h)])
    if op == "median":
        return over(a, np.median)
    if op in ("opening", "closing"):
        first, second = (min, max) if op == "opening" else (max, min)
        return over(over(a, first), second)
    far = np.arange(-int(4 * size + 0.5), int(4 * size + 0.5) + 1)
    g = np.exp(-0.5 * (far / size) ** 2)
    g /= g.sum()
    curve = g * (far**2 / size**4 - 1 / size**2)
    along = lambda wy, wx: np.array([[sum(p * q * mirrored(a, y + i, x + j) for i, p in zip(far, wy) for j, q in zip(far, wx)) for x in range(w)] for y in range(h)])
    if op == "log":
        return -(along(curve, g) + along(g, curve)) * size**2
    return along(g, g) if op == "gaussian" else a - along(g, g)


@pytest.mark.parametrize("op,size", [("median", 1.5), ("opening", 2.0), ("closing", 1.0), ("gaussian", 0.8), ("background", 1.0), ("log", 1.0)])
def test_filters_dont_depend_on_tiles(spark, op, size):
    rng = np.random.default_rng(3)
    pictures = [rng.integers(0, 50, (9, 14)).astype(float), rng.integers(0, 50, (4, 5)).astype(float)]
    rows = [(i, y, x, float(v)) for i, p in enumerate(pictures) for (y, x), v in np.ndenumerate(p)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, v double")
    for tile in (3, 64):
        found = filters.filtered(df, "v", op, size, tile=tile).collect()
        assert len(found) == len(rows)
        for i, p in enumerate(pictures):
            out = np.zeros(p.shape)
            for r in found:
                if r.image_id == i:
                    out[r.y, r.x] = r.value
            assert np.allclose(out, by_force(p, op, size))


def test_tissue_mask(spark):
    rng = np.random.default_rng(8)
    a = np.where(rng.random((12, 15)) < 0.45, 20.0, 200.0) + rng.integers(0, 9, (12, 15))
    df = spark.createDataFrame([(0, y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "image_id long, y long, x long, gray double")
    found = {(r.y, r.x): r.label for r in filters.tissue_mask(df, "gray", 15, 12, closing=1.5, least=4).collect()}
    dark = np.pad(a < 100, 1)
    foot = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    grown = np.array([[any(dark[y + 1 + i, x + 1 + j] for i, j in foot) for x in range(15)] for y in range(12)])
    grown = np.pad(grown, 1)
    closed = {(0, y, x) for y in range(12) for x in range(15) if all(grown[y + 1 + i, x + 1 + j] for i, j in foot)}
    label = components(closed, [(0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])
    sizes = {}
    for root in label.values():
        sizes[root] = sizes.get(root, 0) + 1
    number = {root: n for n, root in enumerate(sorted(sizes), 1)}
    assert found == {c[1:]: number[r] for c, r in label.items() if sizes[r] >= 4} and found


def test_puncta(spark):
    rng = np.random.default_rng(6)
    a = rng.random((20, 24)) * 5
    for y, x, v in ((4, 4, 60), (4, 7, 55), (12, 15, 80), (19, 23, 70), (10, 2, 3)):
        for dy in range(-3, 4):
            for dx in range(-3, 4):
                if 0 <= y + dy < 20 and 0 <= x + dx < 24:
                    a[y + dy, x + dx] += v * np.exp(-(dy * dy + dx * dx) / 2)
    rows = [(i, y, x, float(v)) for i in (0, 1) for (y, x), v in np.ndenumerate(a)]
    found = filters.puncta(spark.createDataFrame(rows, "image_id long, y long, x long, v double"), "v", 24, 20, sigma=1.0, response=8.0, raw=20.0, apart=4.0, aperture=2.0).collect()
    response = by_force(a, "log", 1.0)
    tops = [(y, x) for y in range(20) for x in range(24) if response[y, x] > 8 and a[y, x] > 20 and response[y, x] == response[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2].max()]
    kept = []
    for y, x in sorted(tops, key=lambda p: (-response[p], p)):
        if all((y - b) ** 2 + (x - c) ** 2 >= 16 for b, c in kept):
            kept.append((y, x))
    assert 3 <= len(kept) < len(tops)
    for i in (0, 1):
        assert {(r.y, r.x) for r in found if r.image_id == i} == set(kept)
    for r in found:
        own = [(y, x) for y in range(20) for x in range(24) if (y - r.y) ** 2 + (x - r.x) ** 2 <= 4 and min(kept, key=lambda k: ((k[0] - y) ** 2 + (k[1] - x) ** 2, k)) == (r.y, r.x)]
        assert r.pixels == len(own) and r["sum"] == pytest.approx(sum(a[p] for p in own), abs=1e-3)


def test_morphometrics_of_one_pixel_a_line_and_a_square(spark):
    cells_ = [(1, 0, 0), *((2, 3, x) for x in range(2, 6)), *((3, y, x) for y in (6, 7) for x in (0, 1)), *((4, 10 + i, i) for i in range(3))]
    found = {r.label: r for r in grids.morphometrics(spark.createDataFrame([(0, y, x, k) for k, y, x in cells_], "image_id long, y long, x long, label long")).collect()}
    assert (found[1].reason, found[1].circularity, found[1].eccentricity, found[1].elongation) == ("one pixel", None, None, None)
    assert (found[2].reason, found[2].eccentricity, found[2].elongation, found[2].edges) == ("pixels on a line", 1.0, None, 10)
    assert (found[3].reason, found[3].eccentricity, found[3].elongation, found[3].major) == ("", 0.0, 1.0, 0.25)
    assert found[4].reason == "pixels on a line" and found[4].minor == 0


def test_values_that_arent_finite_count_as_the_median(spark):
    v = [1.0, 2.0, 3.0, 4.0, 5.0, None, float("nan"), float("inf")]
    found = {r.x: r.value for r in grids.normalized(spark.createDataFrame([(0, 0, i, x) for i, x in enumerate(v)], "image_id long, y long, x long, v double"), "v").collect()}
    assert found[0] == 0 and found[4] == 1 and found[5] == found[6] == found[7] == found[2] == 0.5


def test_declared_pipelines_are_validated():
    good = [{"step": "source", "channel": "v"}, {"step": "process", "filter": "median", "size": 1}, {"step": "process", "filter": "subtract", "value": 2}, {"step": "segment", "at_least": 3}, {"step": "measure"}, {"step": "population", "ranges": {}}, {"step": "review", "least_pixels": 1}, {"step": "export", "columns": ["label"]}]
    assert declared.validated(json.dumps(good)) == good
    for wrong in (good[::-1], good[:-1], [*good, good[-1]], [{**good[0], "more": 1}, *good[1:]], [{"step": "source"}, *good[1:]], {"steps": good}, [{"step": "flood"}]):
        with pytest.raises(ValueError):
            declared.validated(json.dumps(wrong))
    for text in ('[{"step": "source", "step": "source", "channel": "v"}]', '[{"step": "segment", "at_least": NaN}]'):
        with pytest.raises(ValueError):
            declared.validated(text)


def test_edits_are_undone_and_done_again(spark):
    edges = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 4), ("h", 1, 2)], "graph string, src long, dst long")
    entries = [("remove", 1, 2), ("remove", 2, 3), ("undo", None, None), ("undo", None, None), ("redo", None, None), ("add", 7, 8), ("redo", None, None), ("add", 5, 6), ("undo", None, None), ("undo", None, None), ("undo", None, None), ("undo", None, None), ("redo", None, None), ("redo", None, None)]
    # Another graph's undo, in between, takes back nothing of the first one.
    other = [("h", 2.5, "undo", None, None), ("h", 3.5, "add", 8, 9)]
    ledger = spark.createDataFrame([("g", float(i), *e) for i, e in enumerate(entries)] + other, "graph string, seq double, op string, src long, dst long")
    found = {(r.graph, r.src, r.dst, r.origin) for r in tracks.edited(edges, ledger).collect()}
    assert found == {("g", 2, 3, "automatic"), ("g", 3, 4, "automatic"), ("g", 7, 8, "manual"), ("h", 1, 2, "automatic"), ("h", 8, 9, "manual")}


def test_sheets_are_applied_whole_or_not_at_all(spark):
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    now = spark.createDataFrame([("a", "S", "one", "x", None, None, None, 3)], "source_id string, study string, sample string, condition string, biological_replicate string, plate string, well string, revision int")
    sheet = lambda *lines: spark.createDataFrame(list(enumerate([",".join(sheets.COLUMNS), *lines], 1)), "row long, line string")
    good = sheets.preview(sheet("a,S,two,y,,P1,", 'b,S,"th""ree, 3",z,r,,'), sources, "S")
    found = {r.source_id: r for r in sheets.apply(good, now, sheets.digest(good)).collect()}
    assert (found["a"].sample, found["a"].revision, found["a"].plate, found["a"].well) == ("two", 4, "P1", None)
    assert (found["b"].sample, found["b"].revision, found["b"].biological_replicate) == ('th"ree, 3', 1, "r") and len(found) == 2
    bad = sheets.preview(sheet("a,S,two,y,,P1,", "z,S,two,y,,,"), sources, "S")
    none = sheets.preview(sheet(), sources, "S")
    for checked, expected in ((good, sheets.digest(bad)), (bad, sheets.digest(bad)), (none, sheets.digest(none))):
        with pytest.raises(ValueError):
            sheets.apply(checked, now, expected)
    wrong = spark.createDataFrame([(1, "source_id,study"), (2, 'a,S,tw"o,y,,,'), (3, "b,S,\ttab,y,,,")], "row long, line string")
    assert {r.row: list(r.issues) for r in sheets.preview(wrong, sources, "S").collect()} == {2: ["header", "quoting", "unknown source"], 3: ["header", "text"]}
    assert [r.study for r in sheets.template(sources, now, "T").orderBy("source_id").collect()] == ["S", "T", "T"]
