"""SimHash near-duplicates.

A text's fingerprint takes the majority of each bit over the XXH64 hashes of
its word shingles. Fingerprints are mapped to the numbers of set bits in their
segments. One differing bit moves one of those numbers by one, so the
Manhattan distance of two such vectors is never above the Hamming distance of
the fingerprints: a range join on the integer grid finds all candidates, which
are then verified bit by bit. For a radius r the grid points within ceil(r/2)
of one vector and floor(r/2) of the other meet in an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.operators.components import connected_components
from .shared import keyed_rows, one_by_one, shuffled, written

#: Segments of the fingerprint: 4 bits each.
SEGMENTS = 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words (all words if there are fewer)."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    begins = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(begins, stops)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed number;
    counted in blocks so that long texts need little memory."""
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        block = hashes[lo : lo + (1 << 16)]
        counts += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprinted(documents: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (64 bits as bigint), one row a row; no words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            found = [majority(shingle_hashes(t.as_py() or "", width, seed)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = keyed_rows(documents, key, text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _grid_points(fps: DataFrame, radius: int) -> DataFrame:
    """fp and cell: each grid point within ``radius`` (0 or 1) of its vector.
    A cell's number holds 3 bits a segment: the set bits, 0 to 4, plus 1."""
    size = 64 // SEGMENTS
    home = F.lit(0).cast("bigint")
    for i in range(SEGMENTS):
        home = home * 8 + F.bit_count(F.shiftrightunsigned("fp", size * i).bitwiseAND(F.lit((1 << size) - 1))) + 1
    steps = [0] + [s * 8**i for i in range(SEGMENTS) for s in (1, -1)] * radius
    return fps.select("fp", home.alias("home"), F.explode(F.array(*(F.lit(s).cast("bigint") for s in steps))).alias("step")).select("fp", (F.col("home") + F.col("step")).alias("cell"))


def close_fingerprints(fps: DataFrame, bits: int = 2) -> DataFrame:
    """All pairs (src > dst) of different fingerprints at ``bits`` (2 at most)
    or fewer differing bits. ``fps``: column fp, without repeats."""
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2")
    left = _grid_points(fps, (bits + 1) // 2).withColumnRenamed("fp", "a")
    right = _grid_points(fps, bits // 2).withColumnRenamed("fp", "b")
    close = (F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return left.join(shuffled(right), (left.cell == right.cell) & close).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def simhash_groups(documents: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, bits: int = 2) -> DataFrame:
    """One row a row of ``documents``: doc_id, fp, component_id.

    component_id is the smallest doc_id that links reach; rows with equal
    fingerprints are linked, so copies meet as one fingerprint and no pairs of
    copies are made. Null and empty texts have fingerprint zero. A bit that
    exactly half of the hashes have is 0. A long text is hashed whole. A null
    doc_id counts as largest: its group's id is null only if all ids are. An
    empty table gives no rows; extra columns are ignored.
    """
    prints = written(fingerprinted(documents, key=key, text=text, width=width, seed=seed))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(close_fingerprints(nodes.select("fp"), bits))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = written(placed)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named)
    group = written(placed.join(named, "root").select("fp", "component_id"))
    return prints.join(group, "fp").select("doc_id", "fp", "component_id")
