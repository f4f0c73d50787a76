"""Collocations, fill-in-middle and substring dedup against brute force, with
nulls, empty and long texts, ties, repeated rows, empty tables and clashing
extra columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridquarry.llm import collocations, fill_in_middle, substring_dedup

SCHEMA = "doc_id long, text string, lang string, rank int, score int, output string, h1 int"


def table(spark, tmp_path_factory, rows):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    # rank, score, output and h1 clash with names that the operators use.
    spark.createDataFrame([(*r, 1, 2, "o", 3) for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


# -- collocations ---------------------------------------------------------------


def brute_collocations(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        found[lang, p] = (a, *min(cuts))
    longer = Counter()
    for (lang, p), (a, *_) in found.items():
        for j in range(2, len(p)):
            for i in range(len(p) - j + 1):
                longer[lang, p[i : i + j]] = max(longer[lang, p[i : i + j]], a)
    out = []
    for lang in {x for x, _ in found}:
        left = [(-s, -a, " ".join(p).encode(), p, k) for (x, p), (a, s, k) in found.items() if x == lang and 100 * longer[x, p] < 80 * a]
        for rank, (s, a, phrase, p, k) in enumerate(sorted(left)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, f[lang, p[:k]], f[lang, p[k:]], n[lang], -s))
    return sorted(out)


def some_phrases(seed, docs=120, vocabulary=14):
    rng = random.Random(seed)
    words = ["kick", "the", "bucket", "now", "Éa", "中文", "A-b", "x"] + [f"w{i}" for i in range(vocabulary)]
    fixed = ["kick the bucket now", "the bucket", "of the united states", "w1 w2", "again again again again again"]
    rows = [(0, None, "en"), (1, "", None), (2, " \t ", "en"), (3, "...!?", "de")]
    for i in range(4, docs):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 12))]
        rows.append((i, "".join(p + rng.choice([" ", "\t", ". ", ", ", "\n", "\r\n", "  "]) for p in parts), rng.choice(["en", "en", "de", None])))
    return rows + [rows[-1], rows[-1], (None, rows[-2][1], "en")]


@pytest.mark.parametrize("seed,least,top", [(1, 3, 2000), (2, 3, 4), (3, 2, 15), (4, 5, 1)])
def test_collocations(spark, tmp_path_factory, seed, least, top):
    rows = some_phrases(seed)
    found = collocations.collocations(table(spark, tmp_path_factory, rows), least=least, top=top)
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations(rows, least, top)


def test_collocations_that_the_first_level_cannot_settle(spark, tmp_path_factory):
    # The best pairs all lie inside longer phrases, so deeper prefixes must grow; the last three words of a phrase begin with a frequent one.
    rows = [(i, f"p{i % 9}a the q{i % 9}b r{i % 9}c. the the the z. the k{i % 3} m{i % 2}", "en") for i in range(200)]
    found = collocations.collocations(table(spark, tmp_path_factory, rows), least=3, top=6)
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations(rows, 3, 6)


def test_collocations_of_nothing_and_of_a_long_text(spark, tmp_path_factory):
    docs = table(spark, tmp_path_factory, [(1, "one two three four " * 20_000, "en"), (2, None, None)])
    rows = [(1, "one two three four " * 20_000, "en")]
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == brute_collocations(rows, 30, 2000)
    assert collocations.collocations(docs.where("doc_id > 5")).collect() == []


def test_scores_pass_64_bits(spark):
    big = [(2**62 + 1, 2**62, 5), (2**63 - 1, 2**63 - 1, 2**63 - 1), (30, 31, 30)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    from pyspark.sql import functions as F

    got = [r.s for r in df.select(collocations._share(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()]
    assert got == [2_000_000 * a // (l + r) for a, l, r in big]


# -- fill in the middle ----------------------------------------------------------


def brute_fim(doc_id, text):
    t = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, t
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < 20:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(0, None, "en"), (1, "", "en"), (2, "a <S> b", "en"), (3, "<<P", "en"), (4, "long Text, " * 50_000, "en"), (-7, "minus", None), (None, "no id", "en"), (None, "no id", "en")]
    rows += [(i, "".join(rng.choice("abZ é中😀\n\x00<>PSM9") for _ in range(rng.randrange(0, 40))), "en") for i in range(5, 400)]
    rows += rows[20:30]
    made = fill_in_middle.restore_text(fill_in_middle.fill_in_middle(table(spark, tmp_path_factory, rows))).collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=key) == sorted(((i, *brute_fim(i, t)) for i, t, _ in rows), key=key)
    assert sorted((str(r.doc_id), r.restored) for r in made) == sorted((str(i), t or "") for i, t, _ in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing_and_by_other_rates(spark, tmp_path_factory):
    docs = table(spark, tmp_path_factory, [(i, f"word {i} more", "en") for i in range(50)])
    assert fill_in_middle.restore_text(fill_in_middle.fill_in_middle(docs.where("doc_id < 0"))).collect() == []
    assert {r.form for r in fill_in_middle.fill_in_middle(docs, cut_percent=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle.fill_in_middle(docs, cut_percent=100, spm_percent=100).collect()} == {"spm"}


def test_rotations_exchange_blocks():
    rng = random.Random(2)
    for _ in range(200):
        b = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 30)))
        lo, cut, hi = sorted(rng.randrange(len(b) + 1) for _ in range(3))
        own = bytearray(b)
        fill_in_middle.rotate(own, lo, cut, hi)
        assert bytes(own) == b[:lo] + b[cut:hi] + b[lo:cut] + b[hi:]


# -- substring dedup -------------------------------------------------------------


def brute_substrings(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    order = [float("inf") if i is None else i for i, _, _ in rows]
    low = {}
    for i, w in zip(order, words):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            low[k] = min(low.get(k, i), i)
    out = []
    for (doc_id, _, _), i, w in zip(rows, order, words):
        gone = {s + j for s in range(len(w) - window + 1) if low[tuple(w[s : s + window])] < i for j in range(window)}
        out.append((doc_id, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def some_spans(seed, docs=60, kinds=40):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(kinds)}" for _ in range(rng.randrange(8, 90))] for _ in range(6)]
    rows = [(0, None, "en"), (1, "", "en"), (2, " \n ", "en"), (3, "short text", "en"), (4, "short text", "en")]
    for i in range(5, docs):
        w = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p if rng.random() < 0.5 else p[a : a + rng.randrange(60)]
            w += [f"É{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 30))]
            w += ["same"] * rng.choice([0, 0, 0, 70])
        rows.append((rng.choice([i, i, i, 7, None]), "".join(x + rng.choice([" ", "\n", "\t ", "\x0b", "  "]) for x in w), "en"))
    near = " ".join(f"n{j}" for j in range(200))
    rows += [(500 + i, near.replace(f"n{7 * i} ", "CHANGED "), "en") for i in range(25)] + [(600 - i, near, "en") for i in range(5)]
    return rows


@pytest.mark.parametrize("seed,window", [(1, 50), (2, 50), (3, 20), (4, 7), (5, 2)])
def test_substring_dedup(spark, tmp_path_factory, seed, window):
    rows = some_spans(seed)
    found = substring_dedup.substring_dedup(table(spark, tmp_path_factory, rows), window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str) == brute_substrings(rows, window)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    for r in found:
        for f in r.factors:  # each factor's windows stand in its reference
            assert f.words >= window and f.ref < (2**63 - 1 if r.doc_id is None else r.doc_id)
            assert r.n_removed >= f.words
    assert any(r.factors for r in found)


def test_substring_dedup_of_nothing_and_of_a_long_text(spark, tmp_path_factory):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(60_000))
    rows = [(1, long, "en"), (2, "head " + long + " tail", "en"), (3, "x " + long[: len(long) // 2] + " y", "en")]
    docs = table(spark, tmp_path_factory, rows)
    got = {r.doc_id: (r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got[1] == (0, long) and got[2] == (60_000, "head tail") and got[3][1].startswith("x ")
    assert substring_dedup.substring_dedup(docs.where("doc_id > 9")).collect() == []
    with pytest.raises(ValueError, match="window"):
        substring_dedup.substring_dedup(docs, window=1)


def test_anchors_depend_on_a_windows_words_alone():
    rng = np.random.default_rng(4)
    g = rng.integers(0, 9, 400).astype(np.uint64)
    for width in (1, 2, 3, 7, 35):
        best = substring_dedup._least(g, width)
        for s in range(len(g) - width + 1):
            own = g[s : s + width]
            assert best[s] == s + np.flatnonzero(own == own.min())[-1]
