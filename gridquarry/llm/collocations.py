"""Phrase collocations by best-first branch and bound over prefix counts.

A phrase's score is floor(2,000,000 a / (l + r)) at its lowest-scoring cut,
where a, l and r count the phrase and its two parts. A longer phrase is never
more frequent than a prefix of it, so for a prefix q

    floor(2,000,000 f(q) / (f(first k words) + f(q))), k < len(q),

is above the score of every phrase that begins with q. All words and all pairs
of frequent words are counted first. Then, for each language, the prefixes
with the highest bounds are grown: those at least as good as a score that
twice as many pairs reach as are asked for. What those prefixes grow to, and
what stands before the phrases of that score (which decides whether they are
dropped), is counted in one pass over the texts a length. Where fewer phrases
survive than are asked for, the next prefixes are taken, down to none.

Words are 64-bit hashes of language and word, which are checked to be one to
one over the whole vocabulary (another seed is taken otherwise), so phrases
are compared exactly. Bitmaps of a fixed size keep most of what can't be
frequent from being counted at all; what they let through wrongly is counted
right and dropped after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import bitmap, in_bitmap, one_by_one, written
from .textbytes import LOWER, mixed, text_slices, word_hashes, word_spans

#: Bits of each bitmap: 8 MB, whatever the tables hold.
FILTER_BITS = 1 << 26
SCALE = 2_000_000
#: A score above all.
_TOP = SCALE + 1
#: Bytes of text that are counted at once, one text at least.
_SLICE = 3 << 20
#: Groups that phrases are ranked in before the best of all groups are.
_GROUPS = 64

# What ends a piece, and what parts its words.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_INSIDE = ~_ENDS
_INSIDE[[9, 32]] = False


class _Words:
    """The words of a slice of texts: ``local`` numbers and ``ids``, and which
    of them the next one follows in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, codes: np.ndarray):
        low = LOWER[data]
        starts, ends, first = word_spans(low, offsets, _INSIDE)
        size = ends - starts
        bounds = np.append(0, np.cumsum(size)).astype(np.int32)
        letters = low[_INSIDE[low]]
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        self.words = words.dictionary
        index = np.asarray(words.indices).astype(np.int64)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.code = codes[row]
        kinds = int(codes.max(initial=0)) + 1
        self.local = index * kinds + self.code
        self.kinds = kinds
        _, at, own = self.words.buffers()
        n = len(self.words)
        at = np.frombuffer(at, np.int32)[: n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        hashes = word_hashes(np.frombuffer(own, np.uint8), at[:-1], at[1:]) if n else np.zeros(0, np.uint64)
        self.ids = mixed(hashes[index] ^ langs.view(np.uint64)[row])
        piece = np.cumsum(_ENDS[low])[starts] if len(starts) else starts
        self.followed = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1]) if len(starts) else np.zeros(0, bool)

    def places(self, k: int) -> np.ndarray:
        """Where ``k`` words stand in one piece."""
        n = len(self.local) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        whole = np.ones(n, dtype=bool)
        for j in range(k - 1):
            whole &= self.followed[j : j + n]
        return np.flatnonzero(whole)

    def counted(self, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """One place and the number of places of each phrase of ``k`` words."""
        most = int(self.local.max(initial=0)) + 1
        key = self.local[places]
        for j in range(1, k):
            if j > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * most + self.local[places + j]
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        return places[at], n


def _hash_of(ids: list[np.ndarray]) -> np.ndarray:
    h = ids[0]
    for j, more in enumerate(ids[1:], 1):
        h = h ^ (more >> np.uint64(17 * j))
    return h


def _hash(*names: str) -> Column:
    """The same as a column."""
    h = F.col(names[0])
    for j, name in enumerate(names[1:], 1):
        h = h.bitwiseXOR(F.shiftrightunsigned(name, 17 * j))
    return h


def _each(batch: pa.RecordBatch) -> Iterator[tuple[_Words, pa.Array]]:
    coded = batch.column("lang").dictionary_encode()
    codes, langs = np.asarray(coded.indices).astype(np.int64), np.asarray(batch.column("salt"))
    for lo, hi, data, offsets in text_slices(batch.column("text"), _SLICE):
        yield _Words(data, offsets, langs[lo:hi], codes[lo:hi]), coded.dictionary


def _vocabulary(rows: DataFrame) -> DataFrame:
    """lang, word, id, f of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            for words, names in _each(batch):
                at, n = words.counted(words.places(1), 1)
                columns = [names.take(pa.array(words.code[at])), words.words.take(pa.array(words.local[at] // words.kinds)).cast(pa.string()), pa.array(words.ids[at].view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if i < 2 else c for i, c in enumerate(columns)], names=["lang", "word", "id", "f"])

    return rows.mapInArrow(run, "lang string, word string, id bigint, f bigint").groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


def _phrases(rows: DataFrame, k: int, least: int, tests: list[list[tuple]]) -> DataFrame:
    """w1 to wk and a of the phrases that at least ``least`` places hold and
    one of ``tests`` lets through: each a list of (bitmap, first word, words)
    that all have to hold."""
    names = [f"w{i + 1}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            for words, _ in _each(batch):
                places = words.places(k)
                passed = np.zeros(len(places), dtype=bool)
                for test in tests:
                    open_ = np.flatnonzero(~passed)
                    for bits, first, length in test:
                        at = places[open_] + first
                        open_ = open_[in_bitmap(bits.value, _hash_of([words.ids[at + j] for j in range(length)]))]
                    passed[open_] = True
                at, n = words.counted(places[passed], k)
                yield pa.RecordBatch.from_arrays([*(pa.array(words.ids[at + j].view(np.int64)) for j in range(k)), pa.array(n)], names=[*names, "a"])

    found = rows.mapInArrow(run, ", ".join(f"{w} bigint" for w in names) + ", a bigint")
    return written(found.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= least))


def _share(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE a / (left + right)), exactly: products may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * F.lit(SCALE).cast("decimal(7,0)"), wide(left) + wide(right))


def _scored(df: DataFrame, cuts: list[tuple[str, str]], prefixes: list[str]) -> DataFrame:
    """``df`` with best (score, k, l, r), that of the lowest-scoring cut, whole
    (no cut's part is uncounted; best is of the others), and bound, the best
    score that a longer phrase with this prefix may have. ``prefixes``: counts
    of the phrase's own prefixes."""
    a = F.col("a")
    known = [F.col(left).isNotNull() & F.col(right).isNotNull() for left, right in cuts]
    sides = [F.when(ok, F.struct(_share(a, F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))) for k, (ok, (left, right)) in enumerate(zip(known, cuts), 1)]
    whole = known[0]
    for ok in known[1:]:
        whole = whole & ok
    bounds = [_share(a, F.col(p), a) for p in prefixes]
    return df.withColumns({"best": F.array_min(F.array(*sides)), "whole": whole, "bound": F.least(*bounds) if len(bounds) > 1 else bounds[0]})


def _with(df: DataFrame, counts: DataFrame, at: list[str], name: str, how: str = "left") -> DataFrame:
    """``df`` with the count of the words in the columns ``at``."""
    own = [f"w{i + 1}" for i in range(len(at))]
    side = counts.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(own)), F.col("a").alias(name))
    on = [df[c] == side[f"_{i}"] for i, c in enumerate(at)]
    return df.join(side, on, how).drop(*(f"_{i}" for i in range(len(own))))


def _best(df: DataFrame, places: int, order: list[Column], key: str) -> DataFrame:
    """The first ``places`` rows of each language with their rank; those of
    each group (by ``key``) are found first, so that no task sorts all rows of
    a language."""
    group = F.pmod(F.xxhash64(key), F.lit(_GROUPS))
    near = df.withColumn("_n", F.row_number().over(W.partitionBy("lang", group).orderBy(*order))).where(F.col("_n") <= places).drop("_n")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= places)


def _level_at(phrases: DataFrame, places: int) -> DataFrame:
    """lang and level: the ``places``-th best score, 0 if there are fewer."""
    top = _best(phrases, places, [F.desc("score")], "w1")
    return top.groupBy("lang").agg(F.when(F.count("*") == places, F.min("score")).otherwise(0).cast("bigint").alias("level"))


def collocations(documents: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, overlap_percent: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases
    of two to four words that stand in ``least`` places at least, by score, a
    (both descending) and phrase (bytes ascending).

    Phrases whose words lie inside a longer one with ``overlap_percent`` of
    their count are dropped; that holds if a phrase longer by one word does,
    since what lies between is as frequent as the longest. A null language is
    ``und``; null and empty texts hold no words; a long text is counted whole,
    in slices of whole texts. Repeated rows count each. Of cuts with equal
    scores the first counts; phrases with equal scores and counts are ordered
    by their bytes, so ties never depend on the plan. Tables without a phrase
    that is frequent enough give no rows; extra columns are ignored.
    """
    name = F.coalesce(documents[lang], F.lit("und"))
    for seed in range(100):
        rows = documents.select(documents[text].alias("text"), name.alias("lang"), F.xxhash64(F.lit(seed), name).alias("salt"))
        vocabulary = written(_vocabulary(rows))
        if not vocabulary.groupBy("id").count().where("count > 1").limit(1).count():
            break
    else:
        raise ValueError("no seed gives each word a hash of its own")
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    words = written(vocabulary.where(F.col("f") >= least).select("lang", "word", F.col("id").alias("w1"), F.col("f").alias("a")))
    bits = lambda df, *names: bitmap(df.select(_hash(*names).alias("h")), "h", FILTER_BITS)
    often = bits(words, "w1")
    two = _phrases(rows, 2, least, [[(often, 0, 1), (often, 1, 1)]])
    two = _with(_with(two, words, ["w1"], "f1", "inner"), words, ["w2"], "f2", "inner").join(words.select("w1", "lang"), "w1")
    two = written(_scored(two, [("f1", "f2")], ["f1"]).withColumn("score", F.col("best.score")))
    pairs = bits(two, "w1", "w2")

    def grown(df: DataFrame, column: str) -> DataFrame:
        """Rows that this wave's level takes in and the one before didn't."""
        return df.join(F.broadcast(levels), "lang").where((F.col(column) >= F.col("level")) & (F.col(column) < F.col("before")))

    three = four = None
    places = 2 * top
    levels = written(_level_at(two, places).withColumn("before", F.lit(_TOP).cast("bigint")))
    while True:
        ahead, behind = bits(grown(two, "bound"), "w1", "w2"), bits(grown(two, "score"), "w1", "w2")
        found = _phrases(rows, 3, least, [[(ahead, 0, 2), (pairs, 1, 2)], [(pairs, 0, 2), (behind, 1, 2)]])
        three = _counts(three, found)
        scored = written(_three(three, two, words))
        ahead, behind = bits(grown(scored, "bound"), "w1", "w2", "w3"), bits(grown(scored, "score"), "w1", "w2", "w3")
        found = _phrases(rows, 4, least, [[(ahead, 0, 3), (pairs, 2, 2)], [(pairs, 0, 2), (behind, 1, 3)]])
        four = _counts(four, found)
        longest = written(_four(four, three, two, words))
        # The last three words may be no prefix that was grown, nor follow one.
        lacking = longest.where("f123 is not null and f234 is null").join(F.broadcast(levels), "lang").where("best.score >= level").select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("w4").alias("w3")).distinct()
        lacking = written(lacking)
        if lacking.limit(1).count():
            three = _counts(three, _phrases(rows, 3, least, [[(bits(lacking, "w1", "w2", "w3"), 0, 3)]]))
            scored, longest = written(_three(three, two, words)), written(_four(four, three, two, words))
        kept = _survivors(two, three, overlap_percent, 2).unionByName(_survivors(scored, four, overlap_percent, 3)).unionByName(_survivors(longest.where("whole"), None, overlap_percent, 4))
        kept = written(kept.join(F.broadcast(levels.select("lang", "level")), "lang").where("score >= level"))
        places *= 4
        deeper = _level_at(two.select("lang", "w1", "score").union(scored.select("lang", "w1", "score")).union(longest.where("whole").select("lang", "w1", "score")), places).withColumnRenamed("level", "deeper")
        settled = levels.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").join(deeper, "lang")
        done = (F.coalesce("kept", F.lit(0)) >= top) | (F.col("level") == 0)
        if not settled.where(~done).limit(1).count():
            break
        levels = written(settled.select("lang", F.when(done, F.col("level")).otherwise(F.least("level", "deeper")).alias("level"), F.col("level").alias("before")))
    named = kept
    for i in range(1, 5):
        named = named.join(words.select(F.col("w1").alias(f"w{i}"), F.col("word").alias(f"_{i}")), f"w{i}", "left")
    named = named.withColumn("phrase", F.concat_ws(" ", "_1", "_2", "_3", "_4"))
    ranked = _best(named, top, [F.desc("score"), F.desc("a"), F.col("phrase")], "phrase")
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "score")


def _counts(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Counts of both; a phrase that was counted twice has the same count."""
    return new if old is None else written(old.union(new).distinct())


def _three(three: DataFrame, two: DataFrame, words: DataFrame) -> DataFrame:
    df = three.join(words.select("w1", "lang", F.col("a").alias("f1")), "w1")
    df = _with(df, words, ["w3"], "f3")
    df = _with(_with(df, two, ["w1", "w2"], "f12"), two, ["w2", "w3"], "f23")
    return _scored(df, [("f1", "f23"), ("f12", "f3")], ["f1", "f12"]).withColumn("score", F.col("best.score"))


def _four(four: DataFrame, three: DataFrame, two: DataFrame, words: DataFrame) -> DataFrame:
    df = four.join(words.select("w1", "lang", F.col("a").alias("f1")), "w1")
    df = _with(df, words, ["w4"], "f4")
    df = _with(_with(df, two, ["w1", "w2"], "f12"), two, ["w3", "w4"], "f34")
    df = _with(_with(df, three, ["w1", "w2", "w3"], "f123"), three, ["w2", "w3", "w4"], "f234")
    return _scored(df, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")], ["f1", "f12"]).withColumn("score", F.col("best.score"))


def _survivors(df: DataFrame, longer: DataFrame | None, percent: int, k: int) -> DataFrame:
    """The phrases of ``df`` that no counted phrase longer by a word and
    frequent enough holds."""
    names = [f"w{i + 1}" for i in range(k)]
    if longer is not None:
        sides = [longer.select(*(F.col(f"w{i + 1 + shift}").alias(f"w{i + 1}") for i in range(k)), F.col("a").alias("_a")) for shift in (0, 1)]
        around = sides[0].union(sides[1]).groupBy(*names).agg(F.max("_a").alias("_a"))
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        df = df.join(around, names, "left").where(F.col("_a").isNull() | (wide("_a") * 100 < wide("a") * percent))
    more = [F.lit(None).cast("bigint").alias(f"w{i}") for i in range(k + 1, 5)]
    return df.select("lang", *names, *more, "a", "best", "score")
