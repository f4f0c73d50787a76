"""Checks that share no code with what they check: models, automaton, and
nulls, long texts, ties and repeated rows of the operators."""

import heapq
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry.llm import chat_repair, language_id, main_text, quality, toxicity


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    x = {"a": rng.normal(size=400), "b": rng.integers(0, 5, 400).astype(float), "c": rng.random(400)}
    y = ((x["a"] > 0.3) & (x["b"] <= 2) | (x["c"] > 0.9)).astype(float)
    flip = rng.random(400) < 0.05
    return x, np.where(flip, 1 - y, y)


def test_lasso_weights_are_optimal(sample):
    x, y = sample
    rules = quality.tree_rules(x, y, trees=5)
    a = np.stack([r.over(x) for r in rules], axis=1).astype(float)
    strength = 2e-3
    b, w = quality.lasso(a, y, strength, rounds=20_000)
    p = 1 / (1 + np.exp(-(a @ w + b)))
    slope = a.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-5
    assert (np.abs(slope) <= strength + 1e-5).all() and (np.abs(slope + strength * np.sign(w)) < 1e-5)[np.abs(w) > 1e-6].all()
    assert 0 < (np.abs(w) > 1e-6).sum() < len(w)


def test_first_split_is_the_best_of_all(sample):
    x, y = sample
    g, h = y - 0.5, np.full(len(y), 0.25)
    cuts = {k: np.unique(np.quantile(v, np.linspace(0.01, 0.99, 64))) for k, v in x.items()}
    paths = quality._tree(x, cuts, g, h, 1, 10)
    gain = lambda low: g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1)
    best = max(gain(x[k] <= at) for k, v in cuts.items() for at in v if 10 <= (x[k] <= at).sum() <= len(y) - 10)
    (name, _, at), = paths[0][0]
    assert gain(x[name] <= at) == pytest.approx(best)
    for path, value in paths:
        own = quality.Rule(path).over(x)
        assert value == pytest.approx(g[own].sum() / (h[own].sum() + 1))


def test_rules_compiled_to_columns_score_alike(spark, sample):
    x, y = sample
    model = quality.fit_rules(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*x.values())], list(x))
    found = [r.s for r in df.select(model.score({k: F.col(k) for k in x}).alias("s")).collect()]
    z = model.intercept + sum(w * r.over(x) for r, w in model.rules)
    assert np.allclose(found, 1 / (1 + np.exp(-z))) and len(model.rules) > 2
    assert ((np.array(found) >= 0.5) == y).mean() > 0.9


def test_statistics_of_texts(spark):
    texts = [None, "", "   ", "One, TWO.\n3 | #! a a", "é" * 3, "word " * 5000]
    columns = quality.statistics(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*(c.alias(k) for k, c in columns.items())).collect()
    for t, r in zip(texts, rows):
        t = t or ""
        w = t.strip(" ").split() or [""]
        n, whole = len(w), max(len(t), 1)
        assert (r.chars, r.words) == (len(t), n)
        assert r.word_length == pytest.approx(len(t) / n) and r.distinct == pytest.approx(len(set(w)) / n)
        assert r.upper == pytest.approx(sum(c.isupper() for c in t) / whole) and r.digits == pytest.approx(sum(c in "0123456789" for c in t) / whole)
        assert r.lines == pytest.approx(t.count("\n") / n) and r.commas == pytest.approx(t.count(",") / n) and r.bars == pytest.approx(t.count("|") / n)


def repair_cost(roles, merge=1.0, insert=1.5, relabel=2.0, name=0.5):
    """Cheapest repair by a search over all legal conversations; the rules are
    written out here once more."""
    known = {"system": "S", "user": "U", "human": "U", "assistant": "A", "bot": "A"}
    after = {"": "SU", "S": "U", "U": "A", "A": "U"}
    queue, done = [(0.0, 0, "")], set()
    while queue:
        cost, i, last = heapq.heappop(queue)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(roles) and last == "A":
            return cost
        for r in after[last]:
            heapq.heappush(queue, (cost + insert, i, r))
        if i < len(roles):
            given = known.get((roles[i] or "").strip().lower())
            for r in "SUA":
                price = 0.0 if r == given else relabel if given else name
                if r in after[last]:
                    heapq.heappush(queue, (cost + price, i + 1, r))
                if r == last:
                    heapq.heappush(queue, (cost + price + merge, i + 1, r))


def test_repairs_are_the_cheapest(spark):
    names = ["system", "user", "assistant", "human", None]
    chats = list(itertools.product(names, repeat=1)) + list(itertools.product(names, repeat=2)) + list(itertools.product(names, repeat=3))
    rng = random.Random(1)
    chats += [tuple(rng.choices(names, k=rng.randrange(4, 30))) for _ in range(40)]
    rows = [(c, t, role, "x") for c, roles in enumerate(chats) for t, role in enumerate(roles)]
    found = chat_repair.repair_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).groupBy("conv_id").agg(F.sum("cost").alias("cost")).collect()
    assert len(found) == len(chats)
    assert [(r.conv_id, r.cost, repair_cost(chats[r.conv_id])) for r in found if abs(r.cost - repair_cost(chats[r.conv_id])) > 1e-9] == []


def test_equal_languages_and_long_and_repeated_texts(spark):
    rows = [(i, "aba caba " * (1 + i % 3), "xx" if i % 2 else "yy") for i in range(40)]
    rows += [(i, "aba caba " * (1 + i % 3), "yy" if i % 2 else "xx") for i in range(40)]
    rows += [(100, "aba caba " * 150_000, "xx"), (101, "aba", "xx"), (101, "aba", "xx")]
    found = language_id.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("doc_id < 100 or doc_id > 100 or true"), folds=10**9)
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append((r.lang_pred, round(r.score, 6)))
    assert len(by[101]) == 2 and len(set(by[101])) == 1
    assert by[100][0][0] in ("xx", "yy")
    tied = language_id.identify_language(spark.createDataFrame([r for r in rows if r[0] < 40], "doc_id long, text string, lang string"), folds=10**9)
    assert {(r.lang_pred, round(r.score, 6)) for r in tied.collect()} == {("xx", 0.5)}


def test_150_uneven_languages_are_all_learned(spark):
    rng = random.Random(7)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(150)]
    rows = []
    for i, letters in enumerate(alphabets):
        for j in range(400 if i == 0 else 4):
            rows.append((len(rows), " ".join("".join(rng.choices(letters, k=5)) for _ in range(30)), f"l{i:03d}"))
    found = language_id.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), folds=4)
    held = [(r.lang_pred, rows[r.doc_id][2]) for r in found.where("held_out").collect()]
    assert len({b for _, b in held}) > 75 and np.mean([a == b for a, b in held]) > 0.9
    assert np.mean([a == b for a, b in held if b != "l000"]) > 0.9


def test_scores_of_long_and_repeated_texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=50) + (["vile", "foul"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, " ".join(words * 20)), (901, " ".join(words * 20) + " vile foul vile"), (902, "vile foul"), (902, "vile foul"), (903, None), (903, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    found = {}
    for r in toxicity.score_toxicity(docs, model).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert not found[900][0].predicted and found[900][0].segments == []
    assert [(s.first, s.end) for s in found[901][0].segments] == [(6000, 6003)]
    assert len(found[902]) == 2 and found[902][0] == found[902][1] and found[902][0].predicted
    assert len(found[903]) == 2 and found[903][0].score == found[903][1].score < 0.3
    scored = {}
    for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect():
        scored.setdefault(r.doc_id, []).append(r.score)
    assert len(scored[902]) == 2 and len(set(scored[902])) == 1 and 0 <= scored[901][0] <= 1


def test_repeated_and_long_pages(spark):
    page = "<article><p>" + "long words, many of them. " * 40_000 + "</p></article>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", "<p>x"), (2, "u", "<p>x"), (None, None, None)], "page_id long, url string, html string")
    found = sorted(((r.page_id or 0, r.n_chars) for r in main_text.extract_main_text(df).collect()))
    assert found == [(0, 0), (1, 40_000 * 26 - 1), (2, 1), (2, 1)]
