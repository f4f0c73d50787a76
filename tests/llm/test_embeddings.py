"""Lattice hashing against brute force."""

import numpy as np
import pytest

from gridquarry.llm import embedding_dedup as e


def test_e8_is_the_nearest_point():
    x = np.random.default_rng(0).normal(0, 1.5, (300, 8))
    p = e.e8(x) / 2
    assert np.allclose(2 * p, np.rint(2 * p)) and (np.rint(2 * p) % 2).std(axis=1).max() == 0 and (p.sum(1) % 2 == 0).all()
    steps = e._shortest() / 2
    assert steps.shape == (240, 8) and np.allclose((steps**2).sum(1), 2)
    own = ((x - p) ** 2).sum(1)
    assert (own[:, None] <= ((x[:, None] - p[:, None] - steps[None]) ** 2).sum(-1) + 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((2000, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * o
    (sa, ha, na), (sb, hb, nb) = e.cells(a), e.cells(b)
    met = ((ha == hb) | (na == hb[:, :, None]).any(2) | (nb == ha[:, :, None]).any(2)).any(1)
    assert (met & (np.bitwise_count((sa ^ sb).view(np.uint64)) <= e.SKETCH_BITS)).mean() > 0.98


def test_groups(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    v = [*base.tolist(), *(base[:10] + 0.01 * rng.standard_normal((10, 16))).tolist(), *[base[0].tolist()] * 5, (3 * base[1]).tolist()]
    rows = [(i, x) for i, x in enumerate(v)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] + [1.0] * 15), (204, []), (205, [1.0, 2.0]), (206, [2.0, 4.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, size string")
    found = {r.vec_id: r for r in e.embedding_groups(df).collect()}
    assert set(found) == {i for i, _ in rows}
    m = np.array(v)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert all(found[i].n_links == near[i].sum() - 1 for i in range(len(v)))
    assert found[40].component_id == 0 and found[45].component_id == 1 and found[31].component_id == 1
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in (200, 201, 202, 203, 204))
    assert found[206].component_id == 205 and not found[206].kept
    assert e.embedding_groups(df.where("false")).count() == 0


def groups_by_force(rows, threshold=0.95):
    """(links, component) of each row (id, vector), by all pairs."""
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if sound[i] and sound[j] and len(v) == len(w) and np.dot(v, w) >= threshold * np.linalg.norm(v) * np.linalg.norm(w):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), float("inf")), float("inf") if k is None else k)
    return [(k, links[i], None if least[top(i)] == float("inf") else least[top(i)]) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [7, 1024])
def test_dense_groups_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(e, "BLOCK", block)
    rng = np.random.default_rng(block)
    unit = lambda n, d: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, d)))
    centre, other = unit(2, 64)
    tight = centre + 0.06 * unit(80, 64)
    loose = other + 0.14 * unit(60, 64)
    chain = [np.cos(t) * centre - np.sin(t) * (other - (other @ centre) * centre) / np.linalg.norm(other - (other @ centre) * centre) for t in np.arange(1, 12) * 0.25]
    vectors = [*tight, *loose, *chain, *unit(120, 64), *tight[:5], 2 * loose[0]]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(None, tight[0].tolist()), (None, (tight[1] * 1.5).tolist()), (3, unit(1, 64)[0].tolist()), (3, loose[2].tolist()), (None, unit(1, 64)[0].tolist()), (None, None), (900, [1.0, 0.0]), (901, [1.0, 0.01])]
    found = [(r.vec_id, r.n_links, r.component_id) for r in e.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    order = lambda x: sorted(x, key=str)
    assert order(found) == order(groups_by_force(rows))


def test_all_links_of_a_table_are_found(spark):
    """Recall over a whole table of the tests' data, against all pairs."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    near = table.selectExpr("vec_id + 100000 as vec_id", "transform(embedding, (x, i) -> cast(x * (1 + 0.2 * sin(i * 7 + vec_id)) as float)) as embedding")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.select("vec_id", "embedding").union(near).collect()]
    found = {r.vec_id: r.n_links for r in e.embedding_groups(table.select("vec_id", "embedding").union(near)).collect()}
    expected = {k: n for k, n, _ in groups_by_force(rows)}
    assert sum(expected.values()) > 100 and sum(found.values()) >= 0.98 * sum(expected.values())
    assert all(found[k] <= n for k, n in expected.items())
