"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes. A byte's code
length is that of PPM with escape method C: the longest known context predicts
it, or escapes to the next shorter one with the symbols seen excluded, down to
a uniform byte. The statistics are frozen after training, so every (context,
byte) has one exact code length a language, and a text's cost is a sum of
table entries. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import each_part, one_by_one, written
from .textbytes import text_slices

#: Code lengths (four bytes times languages) of one part of the model: 16 MB.
#: A larger model has more parts.
PART_CELLS = 1 << 22
#: Dearest code of a byte.
MOST_COST = -np.log2(1e-12)


def four_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the three before it as one number, oldest byte first;
    before a row's start stand zero bytes."""
    b = data.astype(np.uint32)
    out = b.copy()
    head = np.arange(len(b)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in (1, 2, 3):
        older = np.zeros_like(b)
        older[back:] = b[:-back] if len(b) > back else b[:0]
        older[head < back] = 0
        out |= older << np.uint32(8 * back)
    return out


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows (text, lang); each task sums its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in one_by_one(batches):
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                own = _lower(pc.filter(batch.column("text"), pc.equal(langs, lang)))
                for _, _, data, offsets in text_slices(own):
                    grams, n = np.unique(four_grams(data, offsets), return_counts=True)
                    if lang in held:
                        grams = np.concatenate([held[lang][0], grams])
                        n = np.concatenate([held[lang][1], n])
                        grams, place = np.unique(grams, return_inverse=True)
                        n = np.bincount(place, weights=n).astype(np.int64)
                    held[lang] = grams, n
            if sum(len(g) for g, _ in held.values()) > 2_000_000:
                yield from emit(held)
                held = {}
        yield from emit(held)

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, (grams, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class LanguageModel:
    """Frozen statistics of the contexts whose last two bytes, as a number,
    are from ``first`` to before ``end``. ``bits`` holds the code length of each
    byte after each last byte, for each language. ``long`` and ``short`` hold
    those of four and three bytes that any language knows; ``long_escape`` and
    ``short_escape`` what it costs, after three and two bytes, to escape to a
    byte that the context doesn't know."""

    langs: list[str]
    first: int
    end: int
    bits: np.ndarray
    short: tuple[np.ndarray, np.ndarray]
    short_escape: tuple[np.ndarray, np.ndarray]
    long: tuple[np.ndarray, np.ndarray]
    long_escape: tuple[np.ndarray, np.ndarray]

    def lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four bytes, in each language."""
        at, known = _find(self.long[0], grams)
        out = self.long[1][at] if len(self.long[0]) else np.zeros((len(grams), len(self.langs)), dtype=np.float32)
        new = np.flatnonzero(~known)
        if len(new):
            rest = grams[new]
            at, known = _find(self.short[0], rest & np.uint32(0xFFFFFF))
            cost = np.empty((len(new), len(self.langs)), dtype=np.float32)
            cost[known] = self.short[1][at[known]]
            cost[~known] = self.bits[rest[~known] & np.uint32(0xFFFF)]
            at, met = _find(self.short_escape[0], (rest >> np.uint32(8)) & np.uint32(0xFFFF))
            met &= ~known
            cost[met] += self.short_escape[1][at[met]]
            at, known = _find(self.long_escape[0], rest >> np.uint32(8))
            cost[known] += self.long_escape[1][at[known]]
            out[new] = np.minimum(cost, MOST_COST)
        return out

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language, of the bytes whose contexts this part has."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(data):
            return out
        grams = four_grams(data, offsets)
        if self.first > 0 or self.end < 1 << 16:
            pair = (grams >> np.uint32(8)) & np.uint32(0xFFFF)
            own = np.flatnonzero((pair >= self.first) & (pair < self.end))
            row, each = np.repeat(np.arange(len(out)), np.diff(offsets))[own], self.lengths(grams[own])
            for i in range(len(self.langs)):
                out[:, i] = np.bincount(row, weights=each[:, i], minlength=len(out))
            return out
        each = self.lengths(grams)
        full = np.flatnonzero(np.diff(offsets))
        out[full] = np.add.reduceat(each, offsets[full], axis=0, dtype=np.float64)
        return out


def _escapes(total: np.ndarray, kinds: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divisor of a context's counts, and the factor of what it doesn't know."""
    escape = np.where(mass > 0, kinds, 0)  # Without a symbol to escape to, there is no escape.
    whole = total + escape
    return whole, escape / whole / np.where(mass > 0, mass, 1)


def first_orders(many: int, lang: np.ndarray, pair: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probability of each byte after each byte in each language: [last byte
    and byte, language]."""
    out = np.empty((1 << 16, many))
    for i in range(many):
        own = lang == i
        count = np.bincount(pair[own], weights=n[own], minlength=1 << 16).reshape(256, 256)
        up = np.full((1, 256), 1 / 256)
        for c in (count.sum(0, keepdims=True), count):
            left = np.where(c > 0, 0, up)
            total, kinds, mass = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True), left.sum(1, keepdims=True)
            known = total > 0
            whole, factor = _escapes(np.where(known, total, 1), kinds, mass)
            up = np.where(known, c / whole + left * factor, up)
        out[:, i] = up.ravel()
    return out


def compile_model(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, *, after: np.ndarray | None = None, first: int = 0, end: int = 1 << 16) -> LanguageModel:
    """The part ``first`` to ``end`` of the model from its counts ``n`` of
    ``gram`` in language number ``lang``; ``after`` are the ``first_orders`` of
    all counts, by default of these."""
    many = len(langs)
    if after is None:
        after = first_orders(many, lang, gram & 0xFFFF, n)
    lang, gram, n = lang.astype(np.int64), gram.astype(np.int64), n.astype(np.float64)

    def order(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, below):
        """Keys and probabilities of ``gram``, keys and factors of their
        contexts; ``below(lang, gram)`` is a gram's probability in shorter ones."""
        contexts, of = np.unique(gram >> 8, return_inverse=True)
        cell = of * many + lang
        sums = lambda w: np.bincount(cell, weights=w, minlength=len(contexts) * many)
        total, kinds, mass = sums(n), sums(None), 1 - sums(below(lang, gram))
        # Little is left: sum it instead of subtracting.
        for at in np.flatnonzero((total > 0) & (mass < 1e-9)).tolist():
            around = np.setdiff1d((contexts[at // many] << 8) + np.arange(256), gram[cell == at])
            mass[at] = below(np.full(len(around), at % many), around).sum()
        whole, factor = _escapes(np.where(total > 0, total, 1), kinds, mass)
        factor = np.where(total > 0, factor, 1)
        keys, place = np.unique(gram, return_inverse=True)
        p = np.empty((len(keys), many))
        context = np.searchsorted(contexts, keys >> 8)
        for i in range(many):
            p[:, i] = factor[context * many + i] * below(np.full(len(keys), i), keys)
        p[place, lang] = n / whole[cell]
        return keys, p, contexts, factor.reshape(-1, many)

    def one(lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return after[gram & 0xFFFF, lang]

    cells, place = np.unique(lang << 24 | gram & 0xFFFFFF, return_inverse=True)
    pairs = order(cells >> 24, cells & 0xFFFFFF, np.bincount(place, weights=n, minlength=len(cells)), one)

    def two(lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        at, known = _find(pairs[0], gram & 0xFFFFFF)
        context, met = _find(pairs[2], gram >> 8 & 0xFFFF)
        out = one(lang, gram)
        out[met] *= pairs[3][context[met], lang[met]]
        out[known] = pairs[1][at[known], lang[known]]
        return out

    triples = order(lang, gram, n, two)
    bits = lambda p: -np.log2(np.maximum(p, 1e-300)).astype(np.float32)
    table = lambda keys, p: (keys.astype(np.uint32), bits(p))
    return LanguageModel(langs, first, end, bits(np.maximum(after, 1e-12)), table(*pairs[:2]), table(*pairs[2:]), table(triples[0], np.maximum(triples[1], 1e-12)), table(*triples[2:]))


def part_ends(pair: np.ndarray, cells: np.ndarray, most: int) -> list[int]:
    """Where ranges of pairs end that have ``most`` cells at most, or one pair."""
    ends, held = [], 0
    for p, c in sorted(zip(pair.tolist(), cells.tolist())):
        if held and held + c > most:
            ends.append(p)
            held = 0
        held += c
    return [*ends, 1 << 16]


def fit_languages(rows: DataFrame, part_cells: int = PART_CELLS) -> Iterator[LanguageModel]:
    """Parts of the model of all rows (text, lang) without nulls, of all their
    languages and bytes; together they have every context once. The driver
    holds one at a time."""
    found = written(gram_counts(rows.where("text is not null and lang is not null")))
    langs = sorted(r["lang"] for r in found.select("lang").distinct().collect())
    if not langs:
        return
    number = {x: i for i, x in enumerate(langs)}

    def fetch(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = df.select("lang", "gram", "n").toArrow()
        coded = table["lang"].combine_chunks().dictionary_encode()
        own = np.array([number[x] for x in coded.dictionary.to_pylist()], dtype=np.int64)
        return own[coded.indices.to_numpy()] if len(own) else own, table["gram"].to_numpy(), table["n"].to_numpy()

    after = first_orders(len(langs), *fetch(found.groupBy("lang", (F.col("gram") % (1 << 16)).alias("gram")).agg(F.sum("n").alias("n"))))
    pair = F.shiftright("gram", 8) % (1 << 16)
    sizes = found.groupBy(pair.alias("pair"), "gram").agg(F.lit(1).alias("n")).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    first = 0
    for end in part_ends(sizes["pair"].to_numpy(), sizes["n"].to_numpy() * len(langs), part_cells):
        yield compile_model(langs, *fetch(found.where((pair >= first) & (pair < end))), after=after, first=first, end=end)
        first = end


def identify_language(documents: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, carry: list[str] | None = None, part_cells: int = PART_CELLS) -> DataFrame:
    """One row a row: doc_id, text, held_out, lang_pred, score, bits_per_byte,
    and the columns named in ``carry``.

    Learns from the text and non-null language of the rows whose crc32(key as
    text) mod ``folds`` isn't 0; the others are held out. score is the winning
    language's share of the likelihoods. Null texts and texts without a letter
    are ``und`` with score 0, as is every text when there is nothing to learn
    from. A null key counts as the empty text. A long text is scored whole, in
    one row of a task; repeated rows get the same result each. Equal costs go
    to the language that sorts first. Extra columns are ignored. A model of more than
    ``part_cells`` code lengths has several parts; a batch meets each in turn.
    """
    others = [c for c in carry or [] if c not in (key, text)]
    more = F.struct(*(documents[c] for c in others)) if others else F.lit(None).cast("struct<none:int>")
    rows = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"), documents[lang].alias("lang"), more.alias("more"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0
    langs: list[str] = []
    parts = []
    for model in fit_languages(rows.where(~held_out), part_cells):
        langs = model.langs
        parts.append(documents.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            column = batch.column("text")
            low, costs = _lower(column), np.zeros((batch.num_rows, len(langs)))
            for m in each_part(parts):
                for lo, hi, data, offsets in text_slices(low, 1 << 20):
                    costs[lo:hi] += m.costs(data, offsets)
            for lo, hi, _, offsets in text_slices(low, 1 << 20):
                letters = np.asarray(batch.column("letters")[lo:hi].to_numpy(zero_copy_only=False), dtype=bool)
                if langs:
                    cost = costs[lo:hi]
                    best = cost.argmin(1)
                    least = cost[np.arange(len(best)), best]
                    score = 1 / np.exp2(np.maximum(least[:, None] - cost, -1000)).sum(1)
                    pred = np.array(langs, dtype=object)[best]
                else:
                    letters = np.zeros(hi - lo, dtype=bool)
                    pred, score, least = np.full(hi - lo, "und", dtype=object), np.zeros(hi - lo), np.zeros(hi - lo)
                pred[~letters] = "und"
                rate = least / np.maximum(np.diff(offsets), 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], column[lo:hi], batch.column("more")[lo:hi], batch.column("held_out")[lo:hi], pa.array(pred.tolist(), pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, rate, 0.0))],
                    names=["doc_id", "text", "more", "held_out", "lang_pred", "score", "bits_per_byte"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    marked = rows.select("doc_id", "text", "more", held_out.alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    found = marked.mapInArrow(run, f"doc_id {kind}, text string, more {rows.schema['more'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, bits_per_byte double")
    return found.select("doc_id", "text", "held_out", "lang_pred", "score", "bits_per_byte", *(F.col(f"more.`{c}`") for c in others))
