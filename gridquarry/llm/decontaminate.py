"""Benchmark decontamination by winnowing.

Word k-grams are hashed and the smallest hash of every sliding window of
``span - k + 1`` neighbouring k-grams is kept, so each shared run of at least
``span`` words keeps the same k-gram on both sides. A kept k-gram of a document
that items keep too is extended, where it stands, to the runs of ``span`` words
around it, and these meet the items' runs in an equi-join that compares them
word by word: a k-gram that is common on both sides makes no pairs. Items
shorter than ``span`` words are one run each; for those every place is kept.

Two bitmaps, of the items' k-grams and of their runs, whose size is fixed and
doesn't grow with either table, drop what no item has before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed_rows, one_by_one, written
from .textbytes import LOWER, gram_hashes, text_slices, word_hashes, word_spans

#: Bits of each bitmap: 2 MB, whatever the tables hold.
FILTER_BITS = 1 << 24

_RUNS = "array<struct<n:int,h:bigint,at:int,words:array<bigint>>>"


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hash of every ``width`` neighbours (the last of
    equal ones), without repeats."""
    if len(grams) < width:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(len(grams) - width + 1)
    least = grams[best].copy()
    for j in range(1, width):
        h = grams[j : j + len(least)]
        better = h <= least
        least = np.where(better, h, least)
        best = np.where(better, np.arange(j, j + len(least)), best)
    return np.unique(best)


def _in_bitmap(bits: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    slot = (hashes ^ np.uint64(n)) % np.uint64(FILTER_BITS)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _run_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``n`` words from each start on, and their hashes."""
    runs = words[starts[:, None] + np.arange(n)]
    return runs, gram_hashes(runs.reshape(-1), n)[::n] if len(starts) else np.zeros(0, np.uint64)


def _found_runs(n: int, starts: np.ndarray, runs: np.ndarray, hashes: np.ndarray) -> list[dict]:
    return [{"n": n, "h": h, "at": at, "words": w} for h, at, w in zip(hashes.view(np.int64).tolist(), starts.tolist(), runs.view(np.int64).tolist())]


def item_runs(rows: DataFrame, span: int, k: int) -> DataFrame:
    """One row an item: doc_id, n_words, prints (hashes of its kept k-grams, or
    of the item itself if it is shorter than ``span``) and runs (all runs of
    ``span`` words, or the item itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                low = LOWER[data]
                starts, ends, first = word_spans(low, offsets)
                words, prints, runs = word_hashes(low, starts, ends), [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    own, n = words[a:b], min(span, b - a)
                    grams = gram_hashes(own, k if n == span else max(n, 1))
                    kept = grams[winnow(grams, span - k + 1)] if n == span else grams
                    prints.append(np.unique(kept).view(np.int64))
                    at = np.arange(b - a - n + 1) if n else np.zeros(0, np.int64)
                    runs.append(_found_runs(n, at, *_run_hashes(own, at, n)) if n else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(np.diff(first), pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(runs, _RUNS_TYPE)],
                    names=["doc_id", "n_words", "prints", "runs"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, prints array<bigint>, runs {_RUNS}")


_RUNS_TYPE = pa.list_(pa.struct([("n", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("words", pa.list_(pa.int64()))]))


def document_runs(rows: DataFrame, span: int, k: int, lengths: tuple[int, ...], grams_of_items: Broadcast, runs_of_items: Broadcast) -> DataFrame:
    """One row a text: doc_id, mark (hash of the text), n_words, runs: those of
    ``span`` words around kept k-grams, and of each of ``lengths`` words, that
    the bitmaps know."""
    reach = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, whole = (np.frombuffer(b.value, np.uint8) for b in (grams_of_items, runs_of_items))
        for batch in one_by_one(batches):
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                low = LOWER[data]
                starts, ends, first = word_spans(low, offsets)
                words, found = word_hashes(low, starts, ends), []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    own, out = words[a:b], []
                    long = gram_hashes(own, k)
                    at = winnow(long, reach + 1)
                    at = at[_in_bitmap(grams, long[at], span)]
                    if len(at):
                        at = np.unique(at[:, None] - np.arange(reach + 1))
                        at = at[(at >= 0) & (at <= len(own) - span)]
                        runs, hashes = _run_hashes(own, at, span)
                        known = _in_bitmap(whole, hashes, span)
                        out += _found_runs(span, at[known], runs[known], hashes[known])
                    for n in lengths:
                        short = gram_hashes(own, n)
                        at = np.flatnonzero(_in_bitmap(grams, short, n))
                        runs, hashes = _run_hashes(own, at, n)
                        out += _found_runs(n, at, runs, hashes)
                    found.append(out)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("mark")[lo:hi], pa.array(np.diff(first), pa.int64()), pa.array(found, _RUNS_TYPE)], names=["doc_id", "mark", "n_words", "runs"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.withColumn("mark", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, mark bigint, n_words bigint, runs {_RUNS}")


def _bitmap(hashes: DataFrame) -> Broadcast:
    """Bitmap of a table of n, h: its words, a fixed number, come to the driver."""
    slot = F.pmod(F.col("h").bitwiseXOR(F.col("n").cast("bigint")), F.lit(FILTER_BITS))
    # An unsigned hash's remainder equals the signed one's, as the size is a power of two.
    words = hashes.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 32).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot % 32))")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    bitmap[words["at"].to_numpy()] = words["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", span: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Find every run of ``span`` words that a document shares with an item.

    Returns three tables: texts (doc_id, mark, n_words), one row for each row
    of ``documents``; places (doc_id, mark, window, at, n), one row for each
    occurrence of a window in a document; windows (window, item_id). ``mark``
    is a hash of the text, so that rows with a repeated or null id stay apart.

    Null and empty texts have no words and no places; a long text is looked
    through whole, slice by slice; of equal smallest hashes the last place is
    kept, on both sides. Repeated rows share their places. An empty table on
    either side gives no places. Extra columns are ignored.
    """
    items = written(item_runs(keyed_rows(benchmark, item, text), span, k))
    flat = items.select("doc_id", F.explode("runs").alias("p")).select("doc_id", "p.n", "p.h", "p.words")
    index = written(flat.groupBy("n", "h", "words").agg(F.collect_set("doc_id").alias("items")).withColumn("window", F.monotonically_increasing_id()))
    # The lengths below the span that items have: span - 1 at most.
    lengths = tuple(sorted(r[0] for r in index.where(F.col("n") < span).select("n").distinct().collect()))
    length = F.least(F.col("n_words"), F.lit(span)).alias("n")
    grams = _bitmap(items.select(length, F.explode("prints").alias("h")))
    runs = _bitmap(index.select("n", "h"))
    texts = written(document_runs(keyed_rows(documents, key, text), span, k, lengths, grams, runs))
    met = texts.select("doc_id", "mark", F.explode("runs").alias("p")).select("doc_id", "mark", "p.*").distinct()
    known = index.select("n", "h", F.col("words").alias("theirs"), "window")
    places = met.join(known, ["n", "h"]).where(F.col("words") == F.col("theirs")).select("doc_id", "mark", "window", "at", "n")
    return texts.select("doc_id", "mark", "n_words"), places, index.select("window", F.explode("items").alias("item_id"))


def contamination(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit (words inside any window),
    n_items, items_sha256 (of the sorted, comma-joined item ids as text) and
    contaminated. A document without hits has the digest of the empty text."""
    texts, places, windows = decontaminate(documents, benchmark, **options)
    places = written(places)
    hit = (
        places.select("doc_id", "mark", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at"))
        .distinct()
        .groupBy("doc_id", "mark")
        .agg(F.count("*").alias("n_hit"))
    )
    # Windows with the same items, and documents with the same sets of items, are worked out once.
    sets = windows.groupBy("window").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")).withColumn("set", F.sha2(F.to_json("items"), 256))
    sets = written(sets)
    seen = written(places.join(sets.select("window", "set"), "window").groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("set")).alias("sets")))
    each = seen.select("sets").distinct().select("sets", F.explode("sets").alias("set"))
    listed = each.join(sets.select("set", "items").dropDuplicates(["set"]), "set").select("sets", F.explode("items").alias("item")).groupBy("sets").agg(F.sort_array(F.collect_set("item")).alias("items"))
    items = seen.join(listed, "sets").select("doc_id", "mark", "items")
    both = hit.withColumnsRenamed({"doc_id": "d", "mark": "m"}).join(items.withColumnsRenamed({"doc_id": "d2", "mark": "m2"}), F.col("d").eqNullSafe(F.col("d2")) & F.col("m").eqNullSafe(F.col("m2")), "left")
    joined = texts.join(both, texts.doc_id.eqNullSafe(F.col("d")) & texts.mark.eqNullSafe(F.col("m")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_places(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` that hold no window of an item, all columns."""
    _, places, _ = decontaminate(documents, benchmark, key=key, text=text, **options)
    hit = written(places.select(F.col("doc_id").alias("_hit"), F.col("mark").alias("_mark")).distinct())
    return documents.join(hit, documents[key].eqNullSafe(F.col("_hit")) & F.xxhash64(documents[text]).eqNullSafe(F.col("_mark")), "left_anti")
