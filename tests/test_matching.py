"""Matching: tables against lists, groups against components."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from gridquarry.operators import matching


def some_pairs(rng, rows, columns, n):
    pairs = sorted({(rng.randrange(rows), rng.randrange(columns)) for _ in range(n)})
    return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.array([rng.randrange(8) + 0.25 for _ in pairs])


def brute(a, b, cost):
    best = (0, 0.0)
    for k in range(1, len(a) + 1):
        for chosen in itertools.combinations(range(len(a)), k):
            if len({a[i] for i in chosen}) == len({b[i] for i in chosen}) == k:
                best = min(best, (-k, sum(cost[i] for i in chosen)))
    return best


def test_lists_and_tables_and_all_subsets_agree():
    rng = random.Random(1)
    for _ in range(120):
        a, b, cost = some_pairs(rng, rng.randrange(1, 6), rng.randrange(1, 6), rng.randrange(1, 10))
        want = brute(a, b, cost)
        for kept in (np.flatnonzero(matching.matched(a, b, cost)), matching.sparse_assignment(np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1], cost)):
            assert len(set(a[kept])) == len(set(b[kept])) == len(kept)
            assert (-len(kept), cost[kept].sum()) == want


def test_large_components_are_solved_on_lists(monkeypatch):
    rng = random.Random(2)
    a, b, cost = some_pairs(rng, 60, 50, 400)
    table = matching.matched(a, b, cost)
    monkeypatch.setattr(matching, "MOST_CELLS", 0)
    lists = matching.matched(a, b, cost)
    assert table.sum() == lists.sum() and cost[table].sum() == cost[lists].sum()


def test_groups_dealt_whole_and_by_component_agree(spark):
    rng = random.Random(3)
    rows = []
    for g in [None, "p", "q", "r"]:
        a, b, cost = some_pairs(rng, 40, 40, 70)
        rows += [(g, int(x), int(y), float(c)) for x, y, c in zip(a, b, cost)]
    df = spark.createDataFrame(rows, "g string, a long, b long, c double").repartition(5)
    told = []
    for together in (10**6, 1):
        found = matching.best_matching(df, ["g"], "a", "b", "c", together)
        told.append(sorted((str(r.g), r.n, r.c, r.x, r.y) for r in found.groupBy("g").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.count_distinct("a").alias("x"), F.count_distinct("b").alias("y")).collect()))
    want = []
    for g in [None, "p", "q", "r"]:
        own = [r for r in rows if r[0] == g]
        a, b, c = (np.array(x) for x in zip(*(r[1:] for r in own)))
        kept = matching.matched(a, b, c)
        want.append((str(g), int(kept.sum()), float(c[kept].sum()), int(kept.sum()), int(kept.sum())))
    assert told[0] == told[1] == sorted(want)


def test_no_pairs(spark):
    df = spark.createDataFrame([], "g string, a long, b long, c double")
    assert matching.best_matching(df, ["g"], "a", "b", "c").collect() == []
