"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the whole corpus, cut into overlapping blocks. A window of
``window`` words is anchored at the least of its ``GRAM``-word hashes, which
the window's words alone decide, and a block is the run of neighbouring
windows with the same anchor. Blocks meet by their anchors; of the index's
entries for the same words, the one of the smallest document counts. A text
is parsed from left to right: a factor is the longest run of windows that the
index has from one and the same smaller document, and ``window`` words long
at least. Where a factor ends, the windows that straddle its end have entries
of their own, so that each is looked up, and the next factor may overlap.

No pairs are made: blocks with equal words are one entry (copies, however
many, meet there), and only anchors whose blocks differ have their windows
looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bitmap, in_bitmap, numbered, one_by_one, written
from .textbytes import gram_hashes, mixed, text_slices, word_hashes, word_spans

#: Words of the grams that anchors are chosen from.
GRAM = 16
#: Bits of the filter of rows: 2 MB, whatever the tables hold. Rows that it
#: lets through wrongly only cost time.
FILTER_BITS = 1 << 24

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Word bytes: all but space and tab to carriage return.
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[9:14] = _INSIDE[32] = False
_LAST = (1 << 63) - 1


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` neighbours, the last of equal
    ones; by doubling, in log(width) rounds."""
    n = len(values) - width + 1
    place = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        a, b = place[:-step], place[step:]
        place = np.where(values[b] <= values[a], b, a)
        done += step
    return place[:n]


def _run_hashes(sums: np.ndarray, inverse: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the words ``lo`` to ``hi``, the same wherever they stand."""
    return (sums[hi] - sums[lo]) * inverse[lo]


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    powers = np.full(n + 1, _BASE, dtype=np.uint64)
    inverse = np.full(n + 1, _INVERSE, dtype=np.uint64)
    powers[0] = inverse[0] = 1
    np.multiply.accumulate(powers, out=powers), np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * powers[:n], out=sums[1:])
    return sums, inverse


def blocks_of(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """row, anchor, block hash, first window's start and number of windows of
    the blocks in a slice of texts."""
    starts, ends, first = word_spans(data, offsets, _INSIDE)
    n = len(starts) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    words = word_hashes(data, starts, ends)
    gram = min(GRAM, window)
    grams = gram_hashes(words, gram)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    anchor = _least(grams, window - gram + 1)
    whole = row[:n] == row[window - 1 :]
    new = np.ones(n, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:n] != row[: n - 1]) | ~whole[:-1]
    lo = np.flatnonzero(new & whole)
    # A block ends before the next one or before windows that leave the row.
    bounds = np.append(np.flatnonzero(new | ~whole), n)
    hi = bounds[np.searchsorted(bounds, lo, "right")]
    sums, inverse = _sums(words)
    block = mixed(_run_hashes(sums, inverse, lo, hi - 1 + window) ^ mixed((hi - lo).astype(np.uint64) + np.uint64(1 << 32) * (anchor[lo] - lo).astype(np.uint64)))
    return row[lo], grams[anchor[lo]].view(np.int64), block.view(np.int64), lo - first[row[lo]], hi - lo


def window_hashes(data: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """A hash for each window of one text's words."""
    starts, ends, _ = word_spans(data, offsets, _INSIDE)
    sums, inverse = _sums(word_hashes(data, starts, ends))
    lo = np.arange(max(len(starts) - window + 1, 0))
    return mixed(_run_hashes(sums, inverse, lo, lo + window)).view(np.int64)


def _anchored(rows: DataFrame, window: int) -> DataFrame:
    """The blocks of all texts: row_id, rank, anchor, block, start, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            ids, ranks = np.asarray(batch.column("row_id")), np.asarray(batch.column("rank"))
            for lo, hi, data, offsets in text_slices(batch.column("text"), 1 << 20):
                row, *found = blocks_of(data, offsets, window)
                columns = [ids[lo:hi][row], ranks[lo:hi][row], *found]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns[:4]] + [pa.array(c.astype(np.int32)) for c in columns[4:]], names=["row_id", "rank", "anchor", "block", "start", "count"])

    return rows.select("row_id", "rank", "text").mapInArrow(run, "row_id bigint, rank bigint, anchor bigint, block bigint, start int, count int")


def _marked(rows: DataFrame, asked: DataFrame, wanted: bool) -> DataFrame:
    """The rows that a filter of ``asked``'s row_ids lets through (or not)."""
    bits = bitmap(asked.select(F.xxhash64("row_id").alias("h")), "h", FILTER_BITS)
    fields = rows.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            hit = in_bitmap(bits.value, np.asarray(batch.column("_h")))
            kept = batch.select([f.name for f in fields]).filter(pa.array(hit if wanted else ~hit))
            if len(kept):
                yield kept

    return rows.withColumn("_h", F.xxhash64("row_id")).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))


def _windows(rows: DataFrame, entries: DataFrame, window: int) -> DataFrame:
    """anchor, block, nth and win: the windows of the blocks ``entries``
    (row_id, anchor, block, start, count), hashed from their rows' texts."""
    asked = entries.groupBy("row_id").agg(F.collect_list(F.struct("anchor", "block", "start", "count")).alias("asked"))
    texts = _marked(rows.select("row_id", "text"), asked, True).join(asked, "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            lists = batch.column("asked")
            for i in range(len(batch)):
                for _, _, data, offsets in text_slices(batch.column("text").slice(i, 1)):
                    found = window_hashes(data, offsets, window)
                own = lists.slice(i, 1).flatten()
                anchor, block, start, count = (np.asarray(own.field(f)) for f in range(4))
                before = np.cumsum(count) - count
                nth = np.arange(int(count.sum())) - np.repeat(before, count)
                columns = [np.repeat(anchor, count), np.repeat(block, count), nth.astype(np.int32), found[np.repeat(start, count) + nth]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "block", "nth", "win"])

    return texts.select("text", "asked").mapInArrow(run, "anchor bigint, block bigint, nth int, win bigint")


def duplicate_windows(rows: DataFrame, window: int = 50) -> DataFrame:
    """row_id, start, count and refs for each block of ``rows`` (row_id, rank,
    text) that may hold a window of a row with a smaller rank: refs has the
    smallest rank that each of its windows occurs in, or one for all."""
    found = written(_anchored(rows, window))
    anchors = found.groupBy("anchor").agg(F.min("rank").alias("_low"), F.max("rank").alias("_high"), (F.min("block") < F.max("block")).alias("differ"))
    # Written before they are joined, so that Spark can split the partition of an anchor with very many blocks.
    anchors = written(anchors.where("_low < _high").select("anchor", "differ"))
    shared = written(found.join(anchors, "anchor"))
    entries = shared.groupBy("anchor", "block").agg(F.min("rank").alias("low"), F.bool_or("differ").alias("differ"), F.min(F.struct("rank", "row_id", "start", "count")).alias("of"))
    entries = written(entries)
    several = entries.where("differ").select("anchor", "block", "of.row_id", "of.start", "of.count")
    wins = written(_windows(rows, several, window).join(entries.select("anchor", "block", "low"), ["anchor", "block"]))
    least = written(wins.groupBy("anchor", "win").agg(F.min("low").alias("ref")))
    # A block has window - GRAM + 1 windows at most.
    refs = wins.join(least, ["anchor", "win"]).groupBy("anchor", "block").agg(F.array_sort(F.collect_list(F.struct("nth", "ref"))).getField("ref").alias("refs"))
    known = entries.where("not differ").select("anchor", "block", F.array("low").alias("refs")).union(refs)
    met = shared.select("anchor", "block", "row_id", "rank", "start", "count").join(written(known), ["anchor", "block"])
    return met.where(F.exists("refs", lambda r: r < F.col("rank"))).select("row_id", "start", "count", "refs")


def parse(n_words: int, rank: int, pieces: list[tuple[int, int, list[int]]], window: int) -> list[tuple[int, int, int]]:
    """The factors (start, words, reference's rank) of a text, from left to
    right: runs of windows with the same smaller reference."""
    ref = np.full(max(n_words - window + 1, 0), _LAST, dtype=np.int64)
    for start, count, refs in pieces:
        ref[start : start + count] = refs
    ref[ref >= rank] = _LAST
    cuts = np.flatnonzero(np.diff(ref)) + 1
    lows, highs = np.append(0, cuts), np.append(cuts, len(ref))
    return [(int(a), int(b - a + window - 1), int(ref[a])) for a, b in zip(lows, highs) if b > a and ref[a] < _LAST]


def _cut(texts: DataFrame, window: int, id_type: str) -> DataFrame:
    """doc_id, n_words, n_removed, factors and kept of ``texts`` (doc_id, rank,
    text, pieces); pieces null: nothing is removed."""
    factor = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            ranks, kind = np.asarray(batch.column("rank")), batch.column("text").type
            pieces = batch.column("pieces")
            for lo, hi, data, offsets in text_slices(batch.column("text"), 1 << 19):
                starts, ends, first = word_spans(data, offsets, _INSIDE)
                n, removed, factors = np.diff(first), [], []
                keep = np.ones(len(starts), dtype=bool)
                for i in range(lo, hi):
                    own = pieces[i].as_py()
                    found = parse(int(n[i - lo]), int(ranks[i]), [(p["start"], p["count"], p["refs"]) for p in own], window) if own else []
                    factors.append([{"start": a, "words": k, "ref": r} for a, k, r in found])
                    for a, k, _ in found:
                        keep[first[i - lo] + a : first[i - lo] + a + k] = False
                    removed.append(int(n[i - lo]) - int(keep[first[i - lo] : first[i - lo + 1]].sum()))
                row = np.repeat(np.arange(hi - lo), n)[keep]
                # Kept words with a space after each, the row's last one aside.
                size = ends[keep] - starts[keep] + 1
                place = np.cumsum(size) - size
                out = np.full(int(size.sum()), 32, dtype=np.uint8)
                at = np.arange(len(out)) - np.repeat(place, size)
                inside = at < np.repeat(size - 1, size)
                out[inside] = data[(at + np.repeat(starts[keep], size))[inside]]
                last = np.ones(len(row), dtype=bool)
                last[:-1] = row[1:] != row[:-1]
                stay = np.ones(len(out), dtype=bool)
                stay[(place + size - 1)[last]] = False
                length = np.bincount(row, weights=size, minlength=hi - lo).astype(np.int64) - np.bincount(row[last], minlength=hi - lo)
                bounds = np.append(0, np.cumsum(length)).astype(np.int64 if pa.types.is_large_string(kind) else np.int32)
                kept = pa.Array.from_buffers(kind, hi - lo, [None, pa.py_buffer(bounds), pa.py_buffer(out[stay])])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(factors, factor), kept], names=["doc_id", "n_words", "n_removed", "factors", "kept"])

    return texts.select("doc_id", "rank", "text", "pieces").mapInArrow(run, f"doc_id {id_type}, n_words bigint, n_removed bigint, factors array<struct<start:int,words:int,ref:bigint>>, kept string")


def substring_dedup(documents: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """One row a row of ``documents``: doc_id, n_words, n_removed, factors
    (start, words and the document ``ref`` that they are taken from) and kept,
    the words that no factor covers, joined by single spaces.

    Words are runs without white space. A window goes if a document with a
    smaller id holds it; what is removed is judged on the whole input. Rows
    with equal ids are no reference for each other; a null id counts as
    largest. Null and empty texts have no words; texts of fewer than
    ``window`` words stay; a long text is parsed whole by one task, some 60
    bytes a word. An empty table gives none; extra columns are ignored.
    ``documents`` must be read from files, ids must be whole numbers.
    """
    if window < 2:
        raise ValueError("window must be 2 words at least")
    rows = numbered(documents.select(documents[key].alias("doc_id"), documents[text].alias("text")))
    rows = rows.withColumn("rank", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)))
    pieces = duplicate_windows(rows, window).groupBy("row_id").agg(F.collect_list(F.struct("start", "count", "refs")).alias("pieces"))
    pieces = written(pieces)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    none = F.lit(None).cast("array<struct<start:int,count:int,refs:array<bigint>>>")
    # Texts that surely keep all words aren't shuffled.
    clean = _marked(rows, pieces, False).withColumn("pieces", none)
    others = _marked(rows, pieces, True).join(pieces, "row_id", "left")
    return _cut(clean, window, id_type).union(_cut(others, window, id_type))
