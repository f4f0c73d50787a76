"""Licence scan by an exact set-similarity join.

A template is the set of a notice's words. A block is a run of words as long
as the notice and a quarter more; it matches where it holds the threshold of
the template's words: ``THRESHOLD`` tenths, or all of them where a template has
fewer than ``WHOLE`` words, since there one word is what tells two licences
apart. Nothing but that containment decides a match. Template words are ordered
by the number of texts that hold them, rarest first; a matching block must
share one of the first n - need + 1 words, its prefix. Places of prefix words
are joined with the index of prefixes; the words around a place pass a length
bound and a positional bound (words from the token's place in the order on),
then each block is found once, under the rarest of its words.

Many blocks of one notice match, and related templates match it too. A match
weighs one for each word shared, less the words in its span that the template
lacks, or the words by which its span is longer than the notice, whichever are
more; the span starts where the block starts and ends where
that weighs most (of equals: soonest) with words enough shared. A match stays
unless an overlapping block of the same template weighs more, or a match of
another template that holds three quarters of its span weighs more (of equals:
the shorter span, then the smaller template, then the earlier one). Notices
that stand side by side both stay.

A text is parted into words once. What goes on are the places of the words
that templates and phrases have, and these only of texts that hold one of some
words that no match can do without; they go on in segments of bounded length.
Only Spark functions are used; there is no Python on the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_notices import notices
from .shared import keyed_rows, written

# Phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Share of a template's words, in tenths.
THRESHOLD = 8
#: Templates of fewer words must be held whole.
WHOLE = 10
#: Words of all templates, at most; what is broadcast is bounded by it.
MOST_TEMPLATE_WORDS = 20_000
#: Places of template words in a segment, beside those around it.
SEGMENT = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _in_order(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: list[str]
    length: int

    @property
    def width(self) -> int:
        return self.length + self.length // 4

    @property
    def need(self) -> int:
        return len(self.words) if len(self.words) < WHOLE else -(-THRESHOLD * len(self.words) // 10)


def templates_of(texts: dict[str, list[str]]) -> list[Template]:
    out = []
    for label, some in texts.items():
        for text in some:
            if words := _in_order(text):
                out.append(Template(len(out), label, sorted(set(words)), len(words)))
    if sum(len(t.words) for t in out) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"the templates have over {MOST_TEMPLATE_WORDS} words")
    return out


def anchors(templates: list[Template]) -> list[str]:
    """Words of which each match holds one, whatever the corpus: of every
    template n - need + 1, those in the fewest templates, longest first."""
    spread = Counter(w for t in templates for w in t.words)
    return sorted({w for t in templates for w in sorted(t.words, key=lambda w: (spread[w], -len(w), w))[: len(t.words) - t.need + 1]})


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def phrase_places(hits: Column, phrase: str) -> Column:
    """Places where a phrase's words stand in a row, from the places (at) of
    its words (word)."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        start = F.get(hits, i)["at"]
        out = F.lit(True)
        for j, part in enumerate(parts):
            hit = F.get(hits, i + j)
            out = out & (hit["word"] == part) & (hit["at"] == start + j)
        return out

    starts = F.filter(F.sequence(F.lit(0), F.size(hits) - len(parts)), here)
    return F.when(F.size(hits) >= len(parts), F.transform(starts, lambda i: F.get(hits, i)["at"])).otherwise(F.array().cast("array<int>"))


def word_hits(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, mark (hash of the text), n_words, hits: place (at) and word of
    each word of the vocabulary, A-Z lower-cased."""
    words = rows.select("doc_id", F.xxhash64("text").alias("mark"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_ANY_WORD), F.lit(0)).alias("words"))
    # lower() is quick, but takes some other letters to a-z: what it finds is looked at again.
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.lower(F.get("words", i)).isin(vocabulary))
    hits = F.transform(places, lambda i: F.struct(i.alias("at"), F.translate(F.get("words", i), _UPPER, _LOWER).alias("word")))
    hits = F.filter(hits, lambda h: h["word"].isin(vocabulary))
    none = F.array().cast("array<struct<at:int,word:string>>")
    return words.select("doc_id", "mark", F.size("words").alias("n_words"), F.when((F.size("words") > 0) & F.lit(bool(vocabulary)), hits).otherwise(none).alias("hits"))


def prefix_index(spark: SparkSession, templates: list[Template], seen: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(token, number, at) for the tokens of the prefixes, at their places in
    the order from 1; (number, label, n, need, length, width, tokens rarest first)."""
    order = sorted({w for t in templates for w in t.words}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes, known = [], []
    for t in templates:
        tokens = sorted(t.words, key=rank.__getitem__)
        prefixes += [(token, t.number, i + 1) for i, token in enumerate(tokens[: len(tokens) - t.need + 1])]
        known.append((t.number, t.label, len(tokens), t.need, t.length, t.width, tokens))
    return spark.createDataFrame(prefixes, "token string, number int, at int"), spark.createDataFrame(known, "number int, label string, n int, need int, length int, width int, tokens array<string>")


def segments(texts: DataFrame, around: int) -> DataFrame:
    """doc_id, mark, hits, hit: each hit of a text with the hits around it, at
    least ``around`` on both sides, at most 2 * around + SEGMENT. A place has
    one hit at most, so these hold all within ``around`` words."""
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.size("hits") - 1) / SEGMENT).cast("int"), F.lit(0))))
    cut = texts.where(F.size("hits") > 0).select("doc_id", "mark", "hits", parts.alias("part"))
    first = F.greatest(F.col("part") * SEGMENT - around, F.lit(0))
    near = F.slice("hits", first + 1, (F.col("part") + 1) * SEGMENT + around - first)
    own = F.slice("hits", F.col("part") * SEGMENT + 1, F.lit(SEGMENT))
    return cut.select("doc_id", "mark", near.alias("hits"), F.explode(own).alias("hit"))


def matching_blocks(texts: DataFrame, templates: list[Template], seen: dict[str, int]) -> DataFrame:
    """Every block that starts with a template's word and meets the threshold:
    doc_id, mark, number, label, n, width, first, last (the span of the
    most weight), shared, weight. ``texts``: doc_id, mark, hits."""
    # Both tables are as large as the templates, whose words are counted above.
    prefixes, known = prefix_index(texts.sparkSession, templates, seen)
    met = segments(texts, max(t.width for t in templates)).select("doc_id", "mark", "hits", F.col("hit.at").alias("place"), F.col("hit.word").alias("token"))
    met = met.join(F.broadcast(prefixes), "token").join(F.broadcast(known), "number")
    near = F.filter("hits", lambda h: (h["at"] > F.col("place") - F.col("width")) & (h["at"] < F.col("place") + F.col("width")))
    near = met.withColumn("near", near).where(F.size(F.array_distinct("near.word")) >= F.col("need"))  # length
    # The template's words alone, by their places in the order (rank).
    ranked = F.filter(F.transform("near", lambda h: F.struct(h["at"].alias("at"), F.array_position("tokens", h["word"]).cast("int").alias("rank"))), lambda h: h["rank"] > 0)
    ranked = near.select("doc_id", "mark", "number", "label", "n", "need", "length", "width", "place", "at", ranked.alias("ranked"))
    ranked = ranked.where(F.size(F.array_distinct(F.filter(F.col("ranked.rank"), lambda r: r >= F.col("at")))) >= F.col("need"))  # positional
    # Where the same word stood before: a word is new in a block that starts after that.
    before = lambda h: F.array_max(F.transform(F.filter("ranked", lambda o: (o["rank"] == h["rank"]) & (o["at"] < h["at"])), lambda o: o["at"]))
    before = F.transform("ranked", lambda h: F.struct(h["at"].alias("at"), h["rank"].alias("rank"), F.coalesce(before(h), F.lit(-1)).alias("before")))
    starts = ranked.withColumn("near", before).withColumn("first", F.explode(F.filter(F.col("near.at"), lambda at: at <= F.col("place"))))
    held = starts.withColumn("held", F.filter("near", lambda h: (h["at"] >= F.col("first")) & (h["at"] < F.col("first") + F.col("width"))))
    held = held.where(F.array_min("held.rank") == F.col("at")).drop("near", "ranked")  # found under its rarest word
    best = held.withColumn("best", F.aggregate("held", _no_span(), _longer)).where("best.weight is not null")
    return best.select("doc_id", "mark", "number", "label", "n", "width", "first", "best.last", "best.shared", "best.weight").distinct()


def _no_span() -> Column:
    return F.expr("named_struct('seen', 0, 'met', 0, 'weight', cast(null as int), 'last', cast(null as int), 'shared', cast(null as int))")


def _longer(best: Column, h: Column) -> Column:
    """The best span so far, with the next hit seen: ``seen`` words, ``met`` hits."""
    new = h["before"] < F.col("first")
    seen, met, span = best["seen"] + new.cast("int"), best["met"] + 1, h["at"] - F.col("first") + 1
    weight = seen - F.greatest(span - met, span - F.col("length"))
    better = new & (seen >= F.col("need")) & (best["weight"].isNull() | (weight > best["weight"]))
    chosen = {"weight": weight, "last": h["at"], "shared": seen}
    return F.struct(seen.alias("seen"), met.alias("met"), *(F.when(better, c).otherwise(best[name]).alias(name) for name, c in chosen.items()))


def best_matches(matches: DataFrame, widest: int) -> DataFrame:
    """The matches that no better one stands for, as the module says.
    ``matches`` is read twice; overlapping ones meet by ranges of places."""
    weighed = matches.withColumn("span", F.col("last") - F.col("first") + 1).withColumn("range", F.floor(F.col("first") / widest))
    names = ["doc_id", "mark", "number", "n", "first", "last", "span", "weight"]
    other = weighed.select(*(F.col(c).alias(f"_{c}") for c in names), F.explode(F.array(*(F.col("range") + i for i in (-1, 0, 1)))).alias("_range"))
    met = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("mark") == F.col("_mark")) & (F.col("range") == F.col("_range"))
    overlapping = (F.col("number") == F.col("_number")) & (F.abs(F.col("first") - F.col("_first")) < F.col("width")) & (F.col("_weight") > F.col("weight"))
    common = F.least("last", "_last") - F.greatest("first", "_first") + 1
    inside = (F.col("number") != F.col("_number")) & (4 * common >= 3 * F.col("span"))
    before = F.struct(-F.col("_weight"), F.col("_span"), F.col("_n"), F.col("_number")) < F.struct(-F.col("weight"), F.col("span"), F.col("n"), F.col("number"))
    return weighed.join(other, met & (overlapping | (inside & before)), "left_anti").drop("range")


def scan_licenses(documents: DataFrame, *, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row a row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    The base columns tell of the places where a phrase's words stand in a row;
    labels adds those of the best matches of templates (label: notices); score
    is 1 with a base place, else the largest share of a template that a best
    match holds (0 where none matches). Null and empty texts have no words, no
    labels, null places and score 0; a long text is looked through whole, in
    segments; words in equally many texts are ordered by their letters; rows
    that repeat an id or a whole row get a result each; an empty table gives no
    rows; extra columns are ignored.
    """
    phrases = PHRASES if phrases is None else phrases
    known = templates_of(notices() if templates is None else templates)
    vocabulary = sorted({w for t in known for w in t.words} | {w for p in phrases for w in p.split(" ")})
    places = [(label, f"_places_{i}", phrase) for i, (phrase, label) in enumerate(phrases.items())]
    base = word_hits(keyed_rows(documents, key, text), vocabulary).withColumn("held", F.array_distinct("hits.word"))
    base = base.withColumns({name: phrase_places(F.col("hits"), phrase) for _, name, phrase in places})
    every = F.flatten(F.array(*(F.col(name) for _, name, _ in places))) if places else F.array().cast("array<int>")
    labels = F.array_compact(F.array(*(F.when(F.size(name) > 0, F.lit(label)) for label, name, _ in places))).cast("array<string>")
    enough = F.arrays_overlap("held", _strings(anchors(known)))
    base = written(base.select("doc_id", "mark", "n_words", every.alias("places"), F.array_sort(F.array_distinct(labels)).alias("found"), "held", F.when(enough, F.col("hits")).alias("hits")))
    seen = {r["token"]: r["count"] for r in base.select(F.explode("held").alias("token")).groupBy("token").count().collect()}  # a row a template word at most
    if known:
        matches = written(matching_blocks(base.where("hits is not null").select("doc_id", "mark", "hits"), known, seen))
        best = best_matches(matches, max(t.width for t in known)).select("doc_id", "mark", "label", (F.col("shared") / F.col("n")).alias("share"))
    else:
        best = base.select("doc_id", "mark", F.lit("").alias("label"), F.lit(0.0).alias("share")).limit(0)
    blocks = best.groupBy("doc_id", "mark").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")).withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"})
    both = base.drop("held", "hits").join(blocks, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("mark").eqNullSafe(F.col("_mark")), "left")
    all_labels = F.array_sort(F.array_union("found", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join("found", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
