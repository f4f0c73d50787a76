"""The pipeline's stages on a small corpus against brute force."""

import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
VOCABULARY = "the river and a town of stone with many old roads where people walk in spring light over hills".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(rng.choice(VOCABULARY, n)).capitalize() + "."
    texts = [text(60) for _ in range(120)]
    bad = [t.upper().replace(" ", " ### $$$ ") + "!!!" for t in texts[:60]]
    leaks = [f"{text(30)} {ITEM} {text(30)}" for _ in range(5)]
    rows = [(i, t) for i, t in enumerate([*texts, *bad, *leaks, *texts[:10], "", None, "123 456", texts[0] + " "])]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(rows)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_stages(spark, corpus, tmp_path):
    path, texts = corpus
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            rows = docs.collect()
            assert all(r.text == texts[r.doc_id] for r in rows)
            kept[name] = {r.doc_id for r in rows}
    assert kept["language"] == {i for i, t in texts.items() if t and re.search("[^\\W\\d_]", t)}
    assert kept["quality"] == {i for i in kept["language"] if not 120 <= i < 180}
    prints = {i: fingerprint(texts[i]) for i in kept["quality"]}
    root = {i: i for i in prints}
    for i in sorted(prints):
        for j in sorted(prints):
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert kept["near_duplicates"] == set(root.values())
    assert kept["benchmark_passages"] == {i for i in kept["near_duplicates"] if ITEM not in (texts[i] or "")}
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == kept["benchmark_passages"]
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert all(sum(r.length for r in pieces if r.doc_id == i) == n for i, n in total.items())


def test_run_gives_the_last_stage(spark, corpus):
    path, _ = corpus
    assert {"doc_id", "start", "length", "sequence_id"} <= set(corpus_pipeline.run(spark, path).columns)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, corpus, tmp_path, name):
    """Empty tables, nulls, ids that repeat or lack, long texts and columns with clashing names."""
    path, texts = corpus
    stage = dict(corpus_pipeline.STAGES)[name]
    long = texts[3] * 500
    rows = [(None, texts[0], None, None, None), (None, None, None, None, None), (7, texts[7], "en", "s", 3), (7, texts[8], "en", "s", 3), (7, texts[7], "en", "s", 3), (900, long, "en", "s", 1), (901, "", "en", "s", 0), *((i, t, "en", "s", 1) for i, t in texts.items() if 20 <= i < 60)]
    docs = spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, mark string, row_id int")
    docs.write.parquet(f"{tmp_path}/in")
    found = stage(spark, spark.read.parquet(f"{tmp_path}/in"), path).collect()
    none = spark.read.parquet(f"{tmp_path}/in").where("false")
    none.write.parquet(f"{tmp_path}/none")
    assert stage(spark, spark.read.parquet(f"{tmp_path}/none"), path).count() == 0
    kept = sorted((str(r.doc_id), r.text or "") for r in found) if name != "packing" else None
    if name == "packing":
        total = lambda i: sum(r.length for r in found if r.doc_id == i)
        assert total(901) == 1 and total(900) == [r for r in found if r.doc_id == 900][0].doc_tokens and {r.doc_id for r in found} == {r[0] for r in rows}
    elif name in ("language", "quality"):
        wanted = [(str(i), t) for i, t, *_ in rows if t]
        assert [x for x in kept if x[1]] == sorted(wanted)
    elif name == "near_duplicates":
        assert [x for x in kept if x[1] == texts[7]] == [("7", texts[7])] and len([x for x in kept if not x[1]]) == 1
    else:
        assert kept == sorted((str(i), t or "") for i, t, *_ in rows)
