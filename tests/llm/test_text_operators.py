"""Operators on texts against brute force, with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from gridquarry.llm import chat_repair, decontaminate, language_id, license_notices, license_scan, main_text, packing, quality, simhash, textbytes, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "Alpha beta gamma " * 3000
ITEM = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    None,
    "",
    "   ",
    "One, two three! four five SIX seven eight nine ten and eleven",
    f"pad pad {ITEM} tail tail",
    f"pad pad {ITEM} tail tail",
    "x " + ITEM.replace("six", "sixx"),
    "Tiny item here and more; tiny ITEM",
    "Licensed under the Apache License, Version 2.0. all rights RESERVED; CC-BY and cc by",
    "É unicode ñandú — straße 中文",
    LONG,
    LONG + "end",
    "General Public License\n" * 3,
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "de" if i % 3 else None, "s", 1, 2, 3) for i, t in enumerate(TEXTS)]
    rows += [(4, TEXTS[4], "de", "s", 1, 2, 3), (None, "null id", None, "s", 1, 2, 3)]
    # score, fp and mark clash with names that the operators use.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, fp int, mark int")


def empty(df):
    return df.where("false")


def test_simhash(spark, documents):
    found = simhash.simhash_groups(documents).collect()
    assert len(found) == len(TEXTS) + 2

    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {r.doc_id: r.fp & (1 << 64) - 1 for r in found}
    assert all(prints[i] == fingerprint(t) for i, t in enumerate(TEXTS))
    groups = {r.doc_id: r.component_id for r in found}
    assert groups[0] == groups[1] == groups[2] == 0 and groups[5] == groups[4] == 4
    assert empty(simhash.simhash_groups(empty(documents))).count() == 0


def test_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 40)
    fps = {int(b) for b in base}
    for b in base[:20]:
        for n in (1, 2, 3):
            x = int(b) & (1 << 64) - 1
            for bit in rng.choice(64, n, replace=False):
                x ^= 1 << int(bit)
            fps.add(x - (1 << 64) if x >> 63 else x)
    found = {(r.src, r.dst) for r in simhash.close_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    expected = {(max(a, b), min(a, b)) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert found == expected and len(expected) > 40


def test_decontaminate(spark, documents):
    items = [(7, ITEM), (8, "tiny item"), (9, None), (10, ""), (11, ITEM + " thirteen"), (12, "pad")]
    benchmark = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, mark int")
    found = decontaminate.contamination(documents, benchmark)
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(i)
    expected = []
    for t in [*TEXTS, TEXTS[4], "null id"]:
        w, hit, of = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if of_window := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    of |= of_window
        expected.append((len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(map(str, of))).encode()).hexdigest(), bool(hit)))
    got = [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()]
    assert sorted(got) == sorted(expected)
    assert decontaminate.contamination(empty(documents), benchmark).count() == 0
    assert not decontaminate.contamination(documents, empty(benchmark)).where("contaminated").count()
    assert decontaminate.without_places(documents, benchmark).count() == sum(not e[-1] for e in expected)


def test_winnowing_keeps_one_of_every_window():
    h = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    kept = set(decontaminate.winnow(h, 6).tolist())
    assert all(kept & set(range(i, i + 6)) for i in range(len(h) - 5))


def best_labels(w):
    """Labels of the best matches among all runs of words of a text."""
    found = []
    for number, (label, text) in enumerate((label, t) for label, texts in license_notices.notices().items() for t in texts):
        known, wide = set(words(text)), len(words(text)) + len(words(text)) // 4
        need = len(known) if len(known) < 10 else -(-8 * len(known) // 10)
        for i, start in enumerate(w):
            met, ends, foreign = set(), [], 0
            for j in range(i, min(i + wide, len(w))):
                foreign += w[j] not in known
                if w[j] in known - met:
                    met.add(w[j])
                    if len(met) >= need:
                        ends.append((max(j - i + 1 - len(words(text)), foreign) - len(met), j))
            if start in known and ends:
                order, j = min(ends)
                found.append((number, label, wide, i, j, (order, j - i + 1, len(known), number)))
    out = set()
    for number, label, wide, i, j, order in found:
        same = any(o[0] == number and abs(o[3] - i) < wide and o[5][0] < order[0] for o in found)
        other = any(o[0] != number and 4 * (min(o[4], j) - max(o[3], i) + 1) >= 3 * (j - i + 1) and o[5] < order for o in found)
        if not same and not other:
            out.add(label)
    return out


def test_licenses(spark, documents):
    found = {(r.doc_id, r.n_words): r for r in license_scan.scan_licenses(documents).collect()}
    for i, t in enumerate(TEXTS):
        w = words(t)
        places = [(j, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()] for j in range(len(w)) if w[j : j + len(p)] == p]
        r = found[i, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        more = best_labels(w)
        assert r.labels == ",".join(sorted({x for _, x in places} | more)), (i, r.labels)
    assert "apache-2.0" in found[8, len(words(TEXTS[8]))].labels
    assert license_scan.scan_licenses(empty(documents)).count() == 0


GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
BY = "This work is licensed under a Creative Commons Attribution 4.0 International License."
BY_SA = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
# Labels written by hand.
NOTICES = {
    "Licensed under CC BY 4.0": "cc-by,cc-by-4.0",
    "CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
    "Creative Commons CC-BY-NC-SA 3.0": "cc-by,cc-by-nc-sa-3.0",
    BY: "cc-by-4.0",
    BY_SA: "cc-by-sa-4.0",
    f"{BY} {BY_SA}": "cc-by-4.0,cc-by-sa-4.0",
    f"{BY_SA} {BY}": "cc-by-4.0,cc-by-sa-4.0",
    f"{BY} {BY}": "cc-by-4.0",
    f"{BY_SA} {BY_SA} {BY_SA}": "cc-by-sa-4.0",
    f"Text: {BY} Images: ShareAlike.": "cc-by-4.0",
    "This work is licensed under a Creative Commons Attribution 3.0 Germany License.": "cc-by-3.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 2.5 Generic License.": "cc-by-nc-sa-2.5",
    "This work is licensed under a Creative Commons Zero 1.0 Universal License.": "cc0-1.0",
    "released under the Apache license": "",
    "the license is released under embargo": "",
    "He was released from MIT under the old license of 1990": "",
    "Released under the MIT License.": "mit",
    "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0",
    "SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "SPDX-License-Identifier: LGPL-2.1-only OR MPL-2.0": "lgpl-2.1,mpl-2.0",
    "This work is licensed under the GNU Lesser General Public License, version 3": "gpl,lgpl-3.0",
    "This work is licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
    "This work is licensed under the GNU General Public License, version 3. It links a lesser library.": "gpl,gpl-3.0",
    GNU.format("General Public License", "3"): "gpl,gpl-3.0",
    GNU.format("General Public License", "2"): "gpl,gpl-2.0",
    GNU.format("Lesser General Public License", "3"): "gpl,lgpl-3.0",
    GNU.format("Affero General Public License", "3"): "agpl-3.0,gpl",
    f"{GNU.format('General Public License', '2')} {GNU.format('Lesser General Public License', '3')}": "gpl,gpl-2.0,lgpl-3.0",
    f"{GNU.format('Lesser General Public License', '3')} {GNU.format('General Public License', '3')}": "gpl,gpl-3.0,lgpl-3.0",
    "LICENSED UNDER THE apache LICENSE, VERSION 2.0": "apache-2.0",
    "Licensed under the Eclipse Public License, Version 2.0": "",
    "Licensed under the Apac\u212ae License, wor\u212a 2.0": "",
}


def test_notices_get_their_own_labels(spark):
    rows = [(i, pad + t + pad, w) for i, (t, w) in enumerate(NOTICES.items()) for pad in ("", " filler" * 200 + " ")]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string, w string"))
    assert [(r.doc_id, r.labels) for r in found.collect() if r.labels != rows[2 * r.doc_id][2]] == []


def test_long_templates_match_wherever_they_stand(spark):
    own = " ".join(f"t{i}" for i in range(200))
    rows = [(i, f"{'x ' * i}{own}{' y' * 300}") for i in range(0, 400, 37)] + [(900, own[: len(own) // 2])]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string"), templates={"own": [own]}, phrases={})
    assert {r.doc_id for r in found.collect() if r.labels == "own"} == {i for i, _ in rows if i != 900}


def test_a_long_legal_text_goes_on_in_segments(spark):
    """Places of template words in plenty: what a row carries stays bounded."""
    gap = " of the license and this software" * 1000
    rows = [(0, f"{gap} {BY}{gap} {BY_SA}{gap}"), (1, f"{gap} {GNU.format('Lesser General Public License', '3')}"), (2, gap)]
    documents = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r.doc_id: r.labels for r in license_scan.scan_licenses(documents).collect()}
    assert found == {0: "cc-by-4.0,cc-by-sa-4.0", 1: "gpl,lgpl-3.0", 2: ""}
    hits = spark.range(2).selectExpr("id as doc_id", "id as mark", "transform(sequence(0, 4999 - cast(id as int)), i -> named_struct('at', 2 * i, 'word', 'of')) as hits")
    cut = license_scan.segments(hits, 50)
    assert cut.count() == hits.selectExpr("sum(size(hits)) as n").head().n
    assert cut.selectExpr("max(size(hits)) as n").head().n <= license_scan.SEGMENT + 2 * 50
    assert license_scan.scan_licenses(documents, templates={}).where("labels not in ('', 'gpl')").count() == 0


@pytest.mark.parametrize("bins", [1, 5])
def test_packing(spark, documents, bins):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    found = packing.pack(documents, tokenizer_path=path, bins=bins).collect()
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        total = sum(r.length for r in rows)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        assert total <= 1024 and total & (total - 1) == 0
    texts = {**dict(enumerate(TEXTS)), None: "null id"}
    for i, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        rows = sorted((r for r in found if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in rows) == len(ids) * (2 if i == 4 else 1) and all(r.doc_tokens == len(ids) and r.ids == ids[r.start : r.start + r.length] for r in rows)
    assert packing.pack(empty(documents), tokenizer_path=path).count() == 0


def test_piece_ids_equal_the_tokenizers():
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a  b", "x\n\ny", "it's we'll can't. don't!!", "a b c", "é.\nÉ a1 b2. c3!", "日本語 テスト。 x", "\n a", "a ", "  ", " a b", "<|endoftext|> a", "it's\nit", "x\x1cy z", "5½ x²", "a|b |c|", ""]
    parts = ["a", "Ab", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\x85", "\x1c", "'s", "'", "1", "漢", "é", "!", "🙂", "\u200b", " " * 150, "\n" * 120]
    rng = random.Random(3)
    odd += ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(2000)] + [" " * 300_000, "\n" * 300_000]
    expected = [x.ids for x in ids.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in ids.of_column(pa.array(odd))] == expected
    assert [np.frombuffer(ids.of_column(pa.array([t]))[0], "<u2").tolist() for t in odd[:100]] == expected[:100]
    assert ids.of_column(pa.array([], pa.string())) == [] and ids.of_column(pa.array([None, "", None], pa.string())) == [b"", b"", b""]


def test_packing_of_long_and_repeated_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "wird " * 30_000), (1, "wird " * 30_000), (None, "x"), (None, "x"), (2, None)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id int, text string"), tokenizer_path=path, bins=3).collect()
    tokenizer = Tokenizer.from_file(path)
    for i, text in dict(rows).items():
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        own = [r for r in found if r.doc_id == i]
        assert {r.doc_tokens for r in own} == {n} and sum(r.length for r in own) == n * (1 if i == 2 else 2)


def test_bins_are_balanced(spark):
    placed, many = packing.balanced(np.array([5, 1, 9, 7]), np.array([40, 10, 25, 350]), 100.0)
    assert placed == [(1, 0, 1), (5, 0, 1), (7, 1, 4), (9, 5, 1)] and many == 6
    rows = [(i, (7 << 46) + i * 2**22, b"x" * 10) for i in range(1000)] + [(i, (i % 60_000) << 46, b"x" * 10) for i in range(1000, 2000)]
    table = spark.createDataFrame(rows, "doc_id int, place long, ids binary")
    dealt, many = packing.with_bins(table, 8)
    sizes = Counter(r.bin for r in dealt.collect())
    assert sum(sizes.values()) == 2000 and max(sizes) < many <= 17 and max(sizes.values()) <= 275


def test_hilbert_neighbours_touch():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    order = points[np.argsort(packing.hilbert(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    assert sorted(packing.hilbert(points, 3).tolist()) == list(range(512))


def test_language(spark, documents):
    rows = [(i, ("der die und ist nicht " if i % 2 else "the and of is not ") * (1 + i % 4), "de" if i % 2 else "en", 5) for i in range(80)]
    rows += [(100, None, "en", 5), (101, "", None, 5), (102, "12 34 !?", "de", 5), (None, "the and of", "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra int")
    found = {r.doc_id: r for r in language_id.identify_language(docs, carry=["extra"]).collect()}
    assert all(found[i].lang_pred == ("de" if i % 2 else "en") for i in range(80))
    assert [found[i].lang_pred for i in (100, 101, 102, None)] == ["und", "und", "und", "en"] and found[100].extra == 5
    assert {r.held_out for r in found.values()} == {True, False}
    assert language_id.identify_language(empty(docs)).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify_language(nothing).collect()} == {"und"}


def test_code_lengths_are_a_distribution():
    text = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    gram, n = np.unique(language_id.four_grams(text, np.array([0, len(text)])), return_counts=True)
    model = language_id.compile_model(["x"], np.zeros(len(gram), int), gram.astype(np.int64), n)
    assert np.allclose(np.exp2(-model.bits.reshape(-1, 256)).sum(1), 1, atol=1e-3)


def _code_length(counts, context, byte):
    """Bits of ``byte`` after three bytes by PPM, method C; counts: {four bytes: n}."""
    p = np.full(256, 1 / 256)
    for k in range(4):
        c = np.zeros(256)
        for g, n in counts.items():
            c[g[3]] += n * (g[3 - k : 3] == context[3 - k :])
        if c.sum():
            left = np.where(c > 0, 0, p)
            escape = (c > 0).sum() if left.sum() else 0
            p = c / (c.sum() + escape) + (left / left.sum() * escape / (c.sum() + escape) if left.sum() else 0)
    return -np.log2(p[byte])


@pytest.mark.parametrize("part_cells", [1 << 22, 40])
def test_language_models_hold_every_gram(spark, part_cells):
    texts = [("abracadabra", "x"), ("barbara", "x"), ("cadabra abba", "y"), ("zz", "z")]
    models = list(language_id.fit_languages(spark.createDataFrame(texts, "text string, lang string"), part_cells))
    assert models[0].langs == ["x", "y", "z"] and (len(models) > 1) == (part_cells == 40)
    counts = {x: {} for x in "xyz"}
    for t, lang in texts:
        b = b"\0\0\0" + t.encode()
        for i in range(len(t)):
            counts[lang][b[i : i + 4]] = counts[lang].get(b[i : i + 4], 0) + 1
    new = [b"abracadabra", b"zzz", b"q", b"cabba zab"]
    found = sum(m.costs(np.frombuffer(b"".join(new), np.uint8), np.cumsum([0, *map(len, new)])) for m in models)
    for t, row in zip(new, found):
        b = b"\0\0\0" + t
        for lang, bits in zip("xyz", row):
            assert bits == pytest.approx(sum(_code_length(counts[lang], b[i : i + 3], b[i + 3]) for i in range(len(t))), rel=1e-5)


def test_small_language_beside_a_large_one(spark):
    # 260,000 words of one language, each twice, and one text of another.
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    large = [" ".join("".join(w) for w in letters[rng.integers(0, 36, (2600, 6))]) for _ in range(100)]
    rows = [(i, t + " " + t, "large") for i, t in enumerate(large)] + [(1001, "ñandú köpek", "small")]
    docs = spark.createDataFrame([*rows, (5000, "ñandú köpek", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language_id.identify_language(docs).where("doc_id >= 1000").select("doc_id", "lang_pred").collect()}
    assert set(found.values()) == {"small"}


def test_quality(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split(), 40)) + "." for _ in range(150)]
    bad = [t.upper() + " ###$$$ !!! " * 10 for t in good]
    rows = [(i, t, 9) for i, t in enumerate([x for pair in zip(good, bad) for x in pair])] + [(1000, None, 9), (1001, "", 9), (None, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    found = quality.score_quality(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and np.mean([r.predicted == int(r.doc_id % 2 == 0) for r in held]) > 0.95
    nothing = quality.fit_quality(docs, labels.where("false"))
    assert {r.score for r in quality.score_quality(docs, nothing).collect()} == {0.5}
    assert quality.score_quality(empty(docs), model).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(rng.choice(vocabulary, 60))
        if i % 4 == 0:
            for j in range(10, 16):
                w[j] = rng.choice(["vile", "rotten", "foul"])
        rows.append((i, " ".join(w), 3))
    rows += [(1000, None, 3), (1001, "", 3), (None, "vile", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found.values())
    held = [r for i, r in found.items() if i is not None and i < 400 and r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert all(s.first <= 15 and s.end > 10 for s in found[0].segments[:1])
    assert not found[1000].predicted and not found[1001].predicted
    assert toxicity.score_toxicity(empty(docs), model).count() == 0
    toxicity.fit_toxicity(docs, labels.where("toxic = 0"))


def test_every_word_scores_by_its_counts_and_stems(spark):
    # Brute force: counts in dictionaries, by bytes instead of hashes.
    rng = random.Random(5)
    common = [f"c{i}" for i in range(20)] + [f"{a}{b}" for a in ("villain", "neighbour", "réeux") for b in ("s", "ous", "ary", "ê", "hoodlum")]
    rows = [(i, " ".join(rng.choices(common, k=30) + (["foul"] * rng.randrange(1, 4) + [f"nastig{i}"] if i % 3 == 0 else ["kind", f"gentle{i}"])), int(i % 3 == 0)) for i in range(90)]
    rows += [(100 + i, rows[0][1], 1) for i in range(5)] + [(200, None, 1), (201, "", 0), (202, "kind", None), (None, "kind", 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), folds=1, held=1)

    def chain(w):
        b = w.encode()
        return [b[:k] for k in toxicity.STEMS if len(b) > k] + [b + b"$"]

    n, seen = [Counter(), Counter()], set()
    for i, text, y in rows:
        if text and y is not None and i is not None and (text, y) not in seen:
            seen.add((text, y))
            own = Counter()
            for w in words(text):
                own.update(chain(w))
            for v, k in own.items():
                n[y][v] += 1 + np.log(k)
    clean, toxic = (sum(k for v, k in c.items() if v.endswith(b"$")) for c in n)
    share = toxic / (clean + toxic)

    def expected(w):
        q, score = share, 0.0
        for v in chain(w):
            t, c = n[1][v], n[0][v]
            if t + c:
                up, q = q, (t + 20 * q) / (t + c + 20)
                odds = np.log(q / (1 - q)) - np.log(share / (1 - share))
                variance = 1 / (t + 20 * up) + 1 / (c + 20 * (1 - up))
                score = odds * odds**2 / (odds**2 + variance)
        return score

    def found(w):
        low = np.frombuffer(w.encode(), np.uint8)
        (values, back), = toxicity.word_scores(model.parts, [(low, np.array([0]), np.array([len(low)]))])
        return values[back[0], 0]

    every = sorted({w for _, text, y in rows if text and y is not None for w in words(text)})
    assert len(every) > 120 and all(abs(found(w) - expected(w)) < 0.0051 for w in every)
    assert all(abs(found(w)) > 0.004 for w in every if abs(expected(w)) > 0.01)
    # Words that no text holds have their stem's score.
    assert found("nastigly") == pytest.approx(expected("nastigly"), abs=0.0051) and found("nastigly") > 0.5 and found("gentleness") < 0 and found("zzz") == 0


def test_calibration_by_texts_that_did_not_teach_their_words(spark):
    # Words of one text alone tell nothing: without cross-fitting they would.
    rows = [(i, " ".join(f"x{i}y{j}" for j in range(60)), int(i % 2)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    model = toxicity.fit_toxicity(docs, docs, folds=1, held=1, price=0.01)
    new = spark.createDataFrame([(1000 + i, " ".join(f"z{i}y{j}" for j in range(60)), None) for i in range(4)], "doc_id int, text string, toxic int")
    assert all(abs(r.score - 0.5) < 0.1 for r in toxicity.score_toxicity(new, model).collect())


@pytest.mark.parametrize("scale, recall", [("sf0.01", 0.75), ("sf0.1", 0.9)])
def test_toxic_texts_held_out(spark, scale, recall):
    docs, labels = (spark.read.parquet(f"/root/testdata/{scale}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    yes, no = (rows[rows.toxic == y] for y in (1, 0))
    places = rows.score.rank()
    auc = (places[rows.toxic == 1].sum() - len(yes) * (len(yes) + 1) / 2) / (len(yes) * len(no))
    assert auc > 0.95 and yes.predicted.mean() > recall and no.predicted.mean() < 0.03


def test_extreme_value_law_is_recovered():
    rng = np.random.default_rng(2)
    words = rng.integers(20, 2000, 20_000)
    # P(best <= s) = exp(-K n exp(-rate s)), cut off at zero.
    best = np.maximum((np.log(0.002 * words) - np.log(-np.log(rng.random(len(words))))) / 1.7, 0.0)
    k, rate = toxicity.extreme_values(best, words.astype(float))
    assert abs(rate - 1.7) < 0.05 and abs(k - 0.002) < 2e-4
    model = toxicity.ToxicWords(k=k, rate=rate, at=-3.0, by=1.5)
    n = np.array([1, 10, 5000])
    least = model.least(n, 0.3)
    expected = k * n * np.exp(-rate * least)
    p = 1 / (1 + np.exp(-(model.at + model.by * -np.log(-np.expm1(-expected)))))
    assert (np.abs(p - 0.3) < 1e-6)[least > 1e-9].all() and (p[least == 1e-9] >= 0.3).all()


@pytest.mark.parametrize("part_words", [1_000_000, 2])
def test_rare_toxic_words_beside_many_common_ones(spark, part_words):
    # 200,500 neutral words in 17 toxic texts and as many others, toxic ones in 16.
    common = spark.createDataFrame([(" ".join(f"{i:06d}" for i in range(200_500)),)], "text string")
    large = spark.range(34).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")).crossJoin(common).select("doc_id", "text", "toxic")
    rows = [(100 + i, f"vile rotten filth and bile x{i}", 1) for i in range(16)] + [(200 + i, f"a fine day and more y{i}", int(i < 27)) for i in range(70)]
    docs = large.union(spark.createDataFrame([*rows, (999, "a day of vile vile vile vile here", 0)], "doc_id long, text string, toxic int"))
    model = toxicity.fit_toxicity(docs, docs.where("doc_id < 999"), folds=1, held=1, price=0.05, part_words=part_words)
    assert (len(model.parts) > 1) == (part_words == 2)
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs.where("doc_id >= 100"), model).collect()}
    assert [(s.first, s.end) for s in found[100].segments] == [(0, 5)] and not found[200].segments
    # A repeated word counts each time.
    assert [(s.first, s.end) for s in found[999].segments] == [(3, 7)]


def test_maximal_segments():
    def brute(s, lo=0, hi=None):
        hi = len(s) if hi is None else hi
        best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        _, _, _, a, b = best
        return brute(s, lo, a) + [(a, b)] + brute(s, b, hi)

    rng = np.random.default_rng(4)
    for _ in range(60):
        s = np.round(rng.normal(0, 2, 14), 3)
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == brute(s.tolist())


def test_main_text(spark):
    pages = {
        1: ("<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One, two<br>three.<p>Four</article><footer>f</footer></body>", "T & U One, two three. Four"),
        2: (None, ""),
        3: ("", ""),
        4: ("plain   text\nhere", "plain text here"),
        5: ("<div class='sidebar'>menu, menu, menu, menu</div><div id=content><h1>T</h1><p>Hello, world</p><p>Second, para</p></div><div class=comments><p>nice, post, yes, really, long</p></div>", "T Hello, world Second, para"),
        6: ("<script>var t='</p>'</script><style>x</style><nav>n</nav>", ""),
        7: ("<p>A<b>b</b>c &lt;x&gt;&nbsp; d</p>", "Abc <x> d"),
    }
    df = spark.createDataFrame([(i, "u", h, "clash") for i, (h, _) in pages.items()], "page_id long, url string, html string, text string")
    for r in main_text.extract_main_text(df).collect():
        assert r.text == pages[r.page_id][1] and r.n_chars == len(r.text)
    assert main_text.extract_main_text(empty(df)).count() == 0


PROSE = "The river ran high in spring, and the old bridge, which nobody had mended, gave way."
LINKS = "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(6))
#: Pages as (html, texts that belong to the article, texts that don't).
LABELLED = [
    (f"<div id=content class='no-sidebar'><p>{PROSE}</p><p>Second, {PROSE}</p></div><div class=sidebar>Old posts</div>", [PROSE, "Second"], ["Old posts"]),
    (f"<div class='page has-sidebar'><div class=text><p>{PROSE}</p></div></div>", [PROSE], []),
    (f"<article class='post promoted'><p>{PROSE}</p></article>", [PROSE], []),
    (f"<article><p>{PROSE}</p><p class='notice-of-death'>Ann, aged 90, died at home on Sunday, her sons beside her, as she wished.</p></article>", [PROSE, "Ann, aged 90"], []),
    (f"<main><p>{PROSE}</p><section class='related-work'><h2>Earlier</h2><p>{PROSE} Others, too.</p></section></main>", [PROSE, "Earlier", "Others, too."], []),
    (f"<article><p>{PROSE}</p><section id=search-results-explained><p>{PROSE} What you see, and why.</p></section></article>", ["What you see"], []),
    (f"<article><p>Fill in the <span class=form>form</span>, and <b class=menu>wait</b>. {PROSE}</p></article>", ["Fill in the form, and wait."], []),
    (f"<article><p>{PROSE} So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", ["So x=2 holds."], []),
    (f"<article><p>{PROSE}</p><div class=related><ul>{LINKS}</ul></div></article>", [PROSE], ["Page 3"]),
    (f"<div class=wrap><ul>{LINKS}</ul><div class=body><p>{PROSE}</p><p>{PROSE}</p></div></div>", [PROSE], ["Page 3"]),
    (f"<article><p>{PROSE}</p></article><section id=comments>" + f"<div class=c><p>Fine, {PROSE} I agree, truly.</p></div>" * 3 + "</section>", [PROSE], ["I agree"]),
    (f"<div id=main><div class=post><p>{PROSE}</p><p>{PROSE} End.</p></div><ol class='comment-list'><li><p>No, {PROSE} Never, ever.</p></li></ol></div>", ["End."], ["Never, ever"]),
    (f"<div class='cookie-notice'><p>We use cookies, and more cookies, as you know, on this site, always.</p></div><div><p>{PROSE}</p><p>{PROSE}</p></div>", [PROSE], ["cookies"]),
    (f"<header><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>{PROSE}</p><footer>Imprint</footer></article></main><footer>Foot</footer>", ["Title", PROSE], ["Site", "Imprint", "Foot"]),
    (f"<div class=story><div class=part><p>{PROSE} One.</p></div><div class=part><p>{PROSE} Two.</p></div><div class=ad-box><p>Buy, buy, buy now</p></div></div>", ["One.", "Two."], ["Buy"]),
    (f"<article><p>{PROSE}</p><div class='share-buttons'><a href=x>Share</a></div><form><p>Your name</p></form><p hidden>Unseen</p></article>", [PROSE], ["Share", "Your name", "Unseen"]),
    (f"<div class='sidebar-left'><div class=col><p>{PROSE} Alone.</p></div></div>", ["Alone."], []),
]


def test_main_text_of_labelled_pages():
    kept = [(t in main_text.main_text(page)) for page, own, _ in LABELLED for t in own]
    left = [(t not in main_text.main_text(page)) for page, _, other in LABELLED for t in other]
    assert all(kept), [page[:60] for page, own, _ in LABELLED if any(t not in main_text.main_text(page) for t in own)]
    assert all(left), [page[:60] for page, _, other in LABELLED if any(t in main_text.main_text(page) for t in other)]


@pytest.mark.parametrize("page", ["<b>" * 30_000 + "x" + "</i>" * 30_000, "<div>" * 30_000 + "x" + "</p></div>" * 30_000, "<p>x " * 60_000, "<article>" + "<div><p>a, b</p>" * 20_000])
def test_long_and_deep_pages_take_linear_time(page):
    began = time.perf_counter()
    assert main_text.main_text(page)
    assert time.perf_counter() - began < 8


def _cheapest(codes, costs):
    """Least cost over all role sequences, merges and insertions."""
    table = chat_repair.steps(costs)
    best = {0: 0.0}
    for c in codes:
        new = {}
        for state in (1, 2, 3):
            for price, before, _, _ in table[c][state]:
                if before in best:
                    new[state] = min(new.get(state, 9e9), best[before] + price)
        best = new
    return min(p + costs.insert * len(chat_repair.ENDS[s]) for s, p in best.items())


def test_chat_repair(spark):
    rng = np.random.default_rng(2)
    roles = ["system", "user", "assistant", "human", None, "other"]
    rows = [(c, t, roles[rng.integers(6)], f"text {c} {t}") for c in range(30) for t in range(rng.integers(1, 9))]
    rows += [(99, t, roles[rng.integers(6)], "same") for t in range(400)] + [(99, 3, "user", "same")] * 3 + [(None, 0, "user", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    found = {}
    for r in chat_repair.repair_chats(df).collect():
        found.setdefault(r.conv_id, []).append(r)
    given = {}
    for c, t, role, text in rows:
        given.setdefault(c, []).append((t, role is not None, role or "", text or ""))
    assert set(found) == set(given)
    for c, own in found.items():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        codes = [chat_repair._code(r) for _, _, r, _ in sorted(given[c])]
        assert sum(r.cost for r in own) == pytest.approx(_cheapest(codes, chat_repair.Costs()))
        rendered = "".join(r.rendered for r in own)
        sequence = re.findall(r"<\|(system|user|assistant)\|>", rendered)
        assert rendered.endswith("<|end|>\n") and rendered.count("<|end|>") == len(sequence)
        assert re.fullmatch(r"(system,)?(user,assistant,)+", ",".join(sequence) + ",")
    assert chat_repair.repair_chats(empty(df)).count() == 0
