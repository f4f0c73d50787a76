"""Toxic passages by maximum-scoring segments.

A word's score is its log odds between toxic and other labelled texts, both
smoothed by an informative Dirichlet prior: a word is expected to part as its
longest stem (its first bytes) does, and that stem as the next shorter one.
The log odds are shrunk by their posterior variance. Every word so has a
score, for or against; one that no labelled text holds has its stem's. A price
a word is taken off, high enough that texts that aren't toxic sink on average.
The scores along a text form maximal segments, all of which one scan in linear
time finds.

Price and calibration are fitted on scores that the text in hand has not
taught (cross-fitting): counts are kept by fold, and a text's words score by
the counts of the other folds.

The best score S of n words of text that isn't toxic follows an extreme-value
law: such segments number K n exp(-rate S) by chance. K and the rate are fitted
on the best scores of such texts, and a logistic curve turns the evidence into
a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import fold
from .shared import broadcast_if_small, each_part, keyed_rows, one_by_one, written
from .textbytes import LOWER, mixed, text_slices, word_hashes, word_spans

#: Words and stems of one part of a model (a larger one has more parts), and
#: labelled texts whose segment scores calibrate it.
PART_WORDS, SAMPLE = 1_000_000, 20_000
#: Words and stems that a task adds up before it gives their counts away.
TASK_WORDS = 1_000_000
#: Bytes of the stems, shortest first; a word has those shorter than itself.
STEMS = (4, 6, 8)
#: Words that the prior weighs, and folds of the cross-fitting.
WEIGHT, CROSS = 20.0, 4
#: Words that a text needs for its mean score to count for the price.
PRICED_WORDS = 50


@dataclass
class ToxicWords:
    """Scores of words and stems, in parts of (sorted hashes, scores, one
    column or one a fold); a word that isn't there has the score of its longest
    stem that is, zero without one. ``price`` is taken off every word. ``at`` and ``by`` are the logistic
    curve over the evidence."""

    price: float = 0.5
    k: float = 1.0
    rate: float = 1.0
    at: float = 0.0
    by: float = 1.0
    parts: list[Broadcast] = field(default_factory=list)

    def evidence(self, best: Column, words: Column) -> Column:
        """Minus the log of the chance that a text of so many words that isn't
        toxic has a segment of that score; 0 without a segment."""
        expected = F.lit(self.k) * F.greatest(words, F.lit(1)) * F.exp(F.lit(-self.rate) * best)
        return F.when(best > 0, -F.log(-F.expm1(-F.greatest(expected, F.lit(1e-300))))).otherwise(F.lit(0.0))

    def probability(self, best: Column, words: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.at) + F.lit(self.by) * self.evidence(best, words))))

    def least(self, words: np.ndarray, threshold: float) -> np.ndarray:
        """Score from which on a segment among so many words has the
        probability ``threshold``."""
        evidence = (np.log(threshold / (1 - threshold)) - self.at) / self.by if self.by > 0 else np.inf
        if evidence <= 0:
            return np.full(len(words), 1e-9)
        expected = max(-np.log1p(-np.exp(-evidence)), 1e-300)
        return np.maximum((np.log(self.k * np.maximum(words, 1)) - np.log(expected)) / self.rate, 1e-9)


def distinct_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct word, in order, and for each word
    which of them it equals."""
    _, first, back = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[back]


def nodes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each stem's length, and last for the whole words: which words have
    it, and its hashes."""
    out = []
    for k in STEMS:
        own = np.flatnonzero(ends - starts > k)
        out.append((own, mixed(word_hashes(low, starts[own], starts[own] + k) + np.uint64(k))))
    return [*out, (np.arange(len(starts)), word_hashes(low, starts, ends))]


def word_scores(parts: list[Broadcast], texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the texts (bytes, starts, ends): scores of its distinct
    words, a row a word, and for each word its row."""
    held = []
    for low, starts, ends in texts:
        first, back = distinct_words(low, starts, ends)
        held.append([nodes(low, starts[first], ends[first]), back, np.full(len(first), -1), np.zeros((len(first), 1))])
    for hashes, scores in each_part(parts):
        for own in held:
            if own[3].shape[1] != scores.shape[1]:
                own[3] = np.zeros((len(own[2]), scores.shape[1]))
            for level, (words, h) in enumerate(own[0]):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = (hashes[at] == h) & (own[2][words] < level)
                own[2][words[hit]] = level
                own[3][words[hit]] = scores[at[hit]]
    return [(values, back) for _, back, _, values in held]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order: Ruzzo and
    Tompa's scan, over the positive scores alone."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    # start, end, sum before, sum at the end, the last candidate whose sum before is lower
    held: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        start, left, right = i, sums[i], sums[i + 1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((start, i + 1, left, right, j))
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, float(r - l)) for a, b, l, r, _ in held]


def word_counts(rows: DataFrame) -> DataFrame:
    """h (a word or stem), up (its next shorter stem; null: none), level (of
    the stems, from 0; words come last), n_0, n_1, ...: its occurrences in the
    rows (text, side) of each side, over all rows. A side is y * CROSS + fold.
    As words come in bursts, k occurrences in one text count 1 + log k."""

    def summed(h: np.ndarray, up: np.ndarray, level: np.ndarray, side: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((side, h))
        h, side = h[order], side[order]
        head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (side[1:] != side[:-1])]))
        return [h[head], up[order][head], level[order][head], side[head], np.add.reduceat(n[order], head)]

    def of_slice(data: np.ndarray, offsets: np.ndarray, sides: np.ndarray) -> list[np.ndarray] | None:
        low = LOWER[data]
        starts, ends, first = word_spans(low, offsets)
        if not len(starts):
            return None
        row = np.repeat(np.arange(len(sides)), np.diff(first))
        places, back = distinct_words(low, starts, ends)
        # Each word of each text once, with its occurrences there.
        pairs, times = np.unique(row * len(places) + back, return_counts=True)
        row, word = np.divmod(pairs, len(places))
        up, found = np.zeros(len(places), dtype=np.uint64), []
        for level, (own, h) in enumerate(nodes(low, starts[places], ends[places])):
            hashes = np.zeros(len(places), dtype=np.uint64)
            hashes[own] = h
            has = np.zeros(len(places), dtype=bool)
            has[own] = True
            at = np.flatnonzero(has[word])
            r, x, u, k = row[at], hashes[word[at]], up[word[at]], times[at]
            order = np.lexsort((x, r))
            r, x, u, k = r[order], x[order], u[order], k[order]
            if len(x):
                head = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (r[1:] != r[:-1])]))
                found.append((x[head], u[head], np.full(len(head), level, dtype=np.int32), sides[r[head]], 1 + np.log(np.add.reduceat(k, head))))
            up[own] = h
        return summed(*(np.concatenate(c) for c in zip(*found)))

    def batch_of(h: np.ndarray, up: np.ndarray, level: np.ndarray, side: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(up.view(np.int64), mask=up == 0), pa.array(level), pa.array(side), pa.array(n)], names=["h", "up", "level", "side", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in one_by_one(batches):
            sides = np.asarray(batch.column("side"))
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                found = of_slice(data, offsets, sides[lo:hi])
                if found is not None:
                    held = found if held is None else summed(*(np.concatenate(x) for x in zip(held, found)))
                if held is not None and len(held[0]) > TASK_WORDS:
                    yield batch_of(*held)
                    held = None
        if held is not None:
            yield batch_of(*held)

    found = rows.select("text", F.col("side").cast("int")).mapInArrow(run, "h bigint, up bigint, level int, side int, n double")
    sums = [F.sum(F.when(F.col("side") == i, F.col("n")).otherwise(0.0)).alias(f"n_{i}") for i in range(2 * CROSS)]
    return found.groupBy("h").agg(F.min("up").alias("up"), F.min("level").alias("level"), *sums)


def log_odds(counts: DataFrame, share: float, weight: float = WEIGHT) -> DataFrame:
    """h, s_0, s_1, ...: scores of words and stems by all folds, and by all but
    fold 0, 1, ... ``share``: of the words, those in toxic texts.

    The prior of a word is ``weight`` words that part as its stem does (those
    without a stem: as all words do). Its log odds against all words are taken
    times s * s / (s * s + variance). What the counts hold nothing of has its
    stem's score. Scores are rounded to hundredths; what its stem scores alike
    in all columns is left out, so that looking for the stem finds the same.
    """
    sides = range(CROSS + 1)
    whole = float(np.log(share / (1 - share)))

    def scored(own: DataFrame, above: DataFrame | None) -> DataFrame:
        if above is not None:
            own = own.join(above.select(F.col("h").alias("up"), *(F.col(f"{c}_{v}").alias(f"up_{c}_{v}") for c in "qse" for v in sides)), "up", "left")
        columns = {}
        for v in sides:
            q_up, s_up, e_up = (F.coalesce(f"up_{c}_{v}", F.lit(x)) if above is not None else F.lit(x) for c, x in (("q", share), ("s", 0.0), ("e", 0.0)))
            toxic, clean = (sum((F.col(f"n_{y * CROSS + f}") for f in range(CROSS) if f != v - 1), F.lit(0.0)) for y in (1, 0))
            q = (toxic + weight * q_up) / (toxic + clean + weight)
            odds = F.log(q / (1 - q)) - whole
            variance = 1 / (toxic + weight * q_up) + 1 / (clean + weight * (1 - q_up))
            seen = toxic + clean > 0
            columns |= {f"q_{v}": F.when(seen, q).otherwise(q_up), f"s_{v}": F.when(seen, odds * odds * odds / (odds * odds + variance)).otherwise(s_up), f"u_{v}": F.round(s_up, 2)}
        out = own.select("h", *(c.alias(name) for name, c in columns.items()))
        return out.select("*", *(F.round(f"s_{v}", 2).alias(f"e_{v}") for v in sides))

    stems: list[DataFrame] = []
    for level in range(len(STEMS)):
        stems.append(written(scored(counts.where(F.col("level") == level), stems[-1] if stems else None)))
    every = stems[0]
    for more in stems[1:]:
        every = every.unionByName(more)
    out = every.unionByName(scored(counts.where(F.col("level") == len(STEMS)), every))
    differs = F.lit(False)
    for v in sides:
        differs = differs | (F.col(f"e_{v}") != F.col(f"u_{v}"))
    return out.where(differs).select("h", *(F.col(f"e_{v}").cast("float").alias(f"s_{v}") for v in sides))


def best_segments(rows: DataFrame, model: ToxicWords, threshold: float | None = None) -> DataFrame:
    """One row a row (doc_id, text, and others; with a column fold, words score
    by the model's column of that fold): words, mean (of the words'
    scores before the price), best (score of the best segment, 0 without one),
    segments (first word, end word, score) whose probability is ``threshold``
    or more."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            slices = text_slices(batch.column("text"))
            # One part is met slice by slice, several by the whole batch.
            for group in [list(slices)] if len(model.parts) > 1 else ([x] for x in slices):
                yield from score(batch, group)

    def score(batch: pa.RecordBatch, group: list) -> Iterator[pa.RecordBatch]:
        lows = [LOWER[data] for _, _, data, _ in group]
        spans = [word_spans(low, offsets) for low, (_, _, _, offsets) in zip(lows, group)]
        each = word_scores(model.parts, [(low, starts, ends) for low, (starts, ends, _) in zip(lows, spans)])
        folds = np.asarray(batch.column("fold")) if "fold" in others else np.zeros(batch.num_rows, dtype=np.int64)
        for (lo, hi, _, _), (_, _, first), (values, back) in zip(group, spans, each):
            scores = values[back, np.minimum(np.repeat(folds[lo:hi], np.diff(first)), values.shape[1] - 1)]
            n = np.diff(first)
            least = np.full(hi - lo, np.inf) if threshold is None else model.least(n, threshold)
            sums = np.concatenate([[0.0], np.cumsum(scores)])
            mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
            priced = scores - model.price
            rises = np.concatenate([[0], np.cumsum(priced > 0)])[first]
            best, kept = np.zeros(hi - lo), [[] for _ in range(hi - lo)]
            for i in np.flatnonzero(np.diff(rises)).tolist():
                found = maximal_segments(priced[first[i] : first[i + 1]])
                best[i] = max(s for _, _, s in found)
                kept[i] = [{"first": x, "end": y, "score": s} for x, y, s in found if s >= least[i]]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in others), pa.array(n, pa.int64()), pa.array(mean), pa.array(best), pa.array(kept, kind)], names=[*others, "words", "mean", "best", "segments"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"{kinds}, words bigint, mean double, best double, segments array<struct<first:bigint,end:bigint,score:double>>")


def _parts(scores: DataFrame, columns: list[str], part_words: int) -> list[Broadcast]:
    """A model's parts; the driver holds one at a time."""
    out = []
    many = -(-scores.count() // part_words)
    for i in range(many):
        own = (scores.where(F.pmod("h", F.lit(many)) == i) if many > 1 else scores).select("h", *columns).toArrow()
        h = own["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        if len(h):
            values = np.stack([own[c].to_numpy()[order] for c in columns], axis=1)
            out.append(scores.sparkSession.sparkContext.broadcast((h[order], values)))
    return out


def fit_toxicity(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held: int = 2, price: float = 0.5, sample: int = SAMPLE, part_words: int = PART_WORDS) -> ToxicWords:
    """Model of all labelled rows whose fold isn't ``held``.

    Word counts cover all of them, equal texts once. At most ``sample`` rows,
    those with the smallest hash of their key, fit the calibration, by scores
    that their own fold of equal texts hasn't taught; ``price`` is raised until
    99 of 100 of their texts that aren't toxic sink on average. Without labels
    of both kinds every text gets the share of toxic labels (a half without
    any). Rows with a null or another label, or a null key, teach nothing.
    """
    known = labels.select(labels[key].alias("doc_id"), labels[label].cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    texts = keyed_rows(documents, key, text).withColumn("mark", F.xxhash64("text"))
    # Copies would make their words look common: each text teaches once.
    first = written(texts.select("doc_id", "mark").join(broadcast_if_small(known), "doc_id").groupBy("mark", "y").agg(F.min("doc_id").alias("doc_id")))
    own_fold = F.pmod("mark", F.lit(CROSS)).cast("int")
    taught = texts.join(broadcast_if_small(first), ["doc_id", "mark"]).select("text", (F.col("y") * CROSS + own_fold).alias("side"))
    counts = written(word_counts(taught))
    sums = counts.where(F.col("level") == len(STEMS)).agg(*(F.coalesce(F.sum(f"n_{i}"), F.lit(0.0)) for i in range(2 * CROSS))).first()
    n_clean, n_toxic = sum(sums[:CROSS]), sum(sums[CROSS:])
    if not n_toxic or not n_clean:
        sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
        p = (sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + sizes.get(1, 0) + 1)
        return ToxicWords(at=float(np.log(p / (1 - p))), by=0.0)
    scores = written(log_odds(counts, n_toxic / (n_toxic + n_clean)))
    model = ToxicWords(price=price, parts=_parts(scores, ["s_0"], part_words))
    crossed = ToxicWords(price=price, parts=_parts(scores, [f"s_{f + 1}" for f in range(CROSS)], part_words))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample))
    texts = written(texts.join(chosen, "doc_id").select("doc_id", "text", "y", own_fold.alias("fold")))
    drift = best_segments(texts, crossed).where((F.col("y") == 0) & (F.col("words") >= PRICED_WORDS)).agg(F.percentile("mean", 0.99)).first()[0]
    model.price = crossed.price = max(price, 1.25 * (drift or 0.0))
    seen = best_segments(texts, crossed).select("y", "words", "best").orderBy(F.xxhash64("words", "best"), "y").limit(sample).toArrow()
    for part in crossed.parts:
        part.unpersist()
    return calibrated(model, *(seen[c].to_numpy().astype(np.float64) for c in ("best", "words", "y")))


def extreme_values(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """K and rate of the extreme-value law of the best scores, those without
    any segment censored, at the largest likelihood."""
    full = words > 0
    best, words = best[full], words[full]
    some = best > 0
    if not some.any():
        return 0.5 / max(words.sum(), 1.0), 1.0

    def fitted(rate: float) -> tuple[float, float]:
        k = some.sum() / (words[some] @ np.exp(-rate * best[some]) + words[~some].sum())
        return k, some.sum() * (np.log(k * rate) - 1) - rate * best[some].sum()

    rates = np.geomspace(0.05, 50, 400)
    at = max(rates.tolist(), key=lambda r: fitted(r)[1])
    return float(fitted(at)[0]), float(at)


def calibrated(model: ToxicWords, best: np.ndarray, words: np.ndarray, y: np.ndarray) -> ToxicWords:
    """Fit the extreme-value law on texts that aren't toxic and a logistic
    curve of the evidence on all."""
    model.k, model.rate = extreme_values(best[y == 0], words[y == 0])
    expected = model.k * np.maximum(words, 1) * np.exp(-model.rate * best)
    x = np.where(best > 0, -np.log(-np.expm1(-np.maximum(expected, 1e-300))), 0.0)
    middle, scale = x.mean(), max(x.std(), 1e-6)
    z = np.stack([np.ones_like(x), (x - middle) / scale], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w += np.linalg.solve(hess, z.T @ (y - p) - 1e-2 * w)
    model.at, model.by = float(w[0] - w[1] * middle / scale), float(w[1] / scale)
    return model


def score_toxicity(documents: DataFrame, model: ToxicWords, *, key: str = "doc_id", text: str = "text", folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """One row a row: doc_id, held_out, score, predicted, segments.

    segments are the maximal segments that alone would give their text a score
    of ``threshold`` or more. Null, empty and wordless texts have no segment
    and no evidence; a long text is scanned whole; equal scores make one
    segment of the first; a null key is in the fold of the empty text; rows
    that repeat score alike; an empty table gives no rows; extra columns are
    ignored.
    """
    found = best_segments(keyed_rows(documents, key, text), model, threshold)
    scored = found.withColumn("score", model.probability(F.col("best"), F.col("words")))
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "segments")
