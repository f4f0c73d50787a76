"""Packing of documents into token sequences along a space-filling curve.

A document's hashed word vector is projected to a few dimensions, the
projection is turned into a Hilbert key, documents are range-sorted by that
key and packed in its order, so that a sequence holds similar documents.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed_rows, one_by_one, written
from .textbytes import LOWER, text_slices, word_hashes, word_spans

#: Dimensions of the projection and bits of each: 30 bits of Hilbert key.
DIMS, BITS = 3, 10
#: First bits of a place by which ids are counted: 65,536 cells at most.
CELL_BITS = 16
#: Bytes of text whose distinct pieces are worked on together.
SLICE = 12 << 20

# The parting pattern of byte-level BPE, and white space as it knows it.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Pieces that don't stand for themselves: empty, behind white space, or with
#: a run of white space that is too long for the faster encoder.
UNFIT = f"^$|^{_SPACE}|{_SPACE}{{100}}"
LONG_SPACE = re.compile(r"\s{100}")


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of unsigned coordinates (Skilling's
    transposed form, turned into one number)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


class Pieces:
    """The distinct pieces between single spaces of a column of texts, and
    which of them each text has. What is worked out for a piece serves all its
    occurrences."""

    def __init__(self, column: pa.Array):
        parts = pc.split_pattern(column.fill_null(""), " ")
        coded = parts.flatten().dictionary_encode()
        self.words = coded.dictionary
        self.which = coded.indices.to_numpy()
        self.ends = np.cumsum(pc.list_value_length(parts).to_numpy(), dtype=np.int64)
        self.heads = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)  # no text is without a piece

    def sums(self, of_piece: np.ndarray) -> np.ndarray:
        """Sum over the pieces of each text."""
        return np.add.reduceat(of_piece[self.which], self.heads)


def curve_keys(pieces: Pieces) -> np.ndarray:
    """Hilbert key of each text: signed sums of its words' hashes, by the
    square root of their number, squeezed evenly into the grid."""
    n, signed = [], []
    for _, _, data, offsets in text_slices(pieces.words):
        low = LOWER[data]
        starts, ends, first = word_spans(low, offsets)
        h = word_hashes(low, starts, ends)
        n.append(np.diff(first))
        for_dim = []
        for d in range(DIMS):
            sums = np.concatenate([[0], np.cumsum(((h >> np.uint64(d)) & np.uint64(1)).astype(np.int64) * 2 - 1)])
            for_dim.append(sums[first[1:]] - sums[first[:-1]])
        signed.append(for_dim)
    root = np.sqrt(np.maximum(pieces.sums(np.concatenate(n)), 1))
    grid = np.empty((len(root), DIMS), dtype=np.int64)
    for d in range(DIMS):
        z = pieces.sums(np.concatenate([s[d] for s in signed])) / root
        grid[:, d] = np.clip(((np.tanh(z * 0.5) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert(grid, BITS)


def _letter_bytes() -> dict[str, int]:
    """The byte that each character of byte-level BPE stands for: printable
    bytes stand for themselves, the others for the characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """Token ids of texts by a byte-level BPE in a file of ``tokenizers``.

    Such a tokenizer parts a text before every single space between two
    characters that aren't white space, so the pieces between have ids of their
    own, and only their first id stands for a space. The distinct pieces of a
    column are joined by spaces and encoded together; the ids are parted again
    before each space. Texts with white space beside a space are encoded whole.
    Where ids are in the order of the merges, ``tiktoken`` encodes by the same
    vocabulary, which is faster (but fails on very long runs of white space).
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"] for x in spec["added_tokens"]}
        letters = _letter_bytes()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        merged = ["".join(x if isinstance(x, list) else x.split(" ")) for x in spec["model"]["merges"]]
        if [spec["model"]["vocab"][x] for x in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("the ids must be in the order of the merges")
        self.bpe = tiktoken.Encoding("pieces", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})
        many = max(ranks.values()) + 1
        self.code = "<u4" if many > 1 << 16 else "<u2"
        self.leads = np.zeros(many, dtype=bool)
        self.leads[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def encode(self, text: str) -> np.ndarray:
        if LONG_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.code)
        return np.array(self.bpe.encode_ordinary(text), dtype=self.code)

    def of_column(self, column: pa.Array, pieces: Pieces | None = None) -> list[bytes]:
        """Ids of each text, as bytes of little-endian numbers."""
        pieces = pieces or Pieces(column)
        if not len(column):
            return []
        unfit = pc.match_substring_regex(pieces.words, UNFIT)
        words = pc.if_else(unfit, "x", pieces.words)
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = np.array(self.bpe.encode_ordinary(" " + line), dtype=self.code)
        begin = np.flatnonzero(self.leads[ids])
        if len(begin) != len(words):
            raise ValueError("the tokenizer doesn't part texts before spaces")
        size = np.diff(begin, append=len(ids))
        # The head of a text has no space before it: an entry of its own.
        heads = [x.as_py() for x in pieces.words.take(pa.array(pieces.which[pieces.heads]))]
        own = [np.array(self.bpe.encode_ordinary(x), dtype=self.code) if not LONG_SPACE.search(x) else ids[:0] for x in heads]
        which = pieces.which.astype(np.int64)
        which[pieces.heads] = len(words) + np.arange(len(heads))
        own_size = np.array([len(x) for x in own], dtype=np.int64)
        begin = np.concatenate([begin, len(ids) + np.cumsum(own_size) - own_size])
        size = np.concatenate([size, own_size])
        ids = np.concatenate([ids, *own])
        take = size[which]
        end = np.cumsum(take)
        place = np.arange(end[-1], dtype=np.int32 if len(ids) < 1 << 31 and end[-1] < 1 << 31 else np.int64)
        place += np.repeat(begin[which] - (end - take), take).astype(place.dtype)
        out = memoryview(ids[place]).cast("B")
        edge = (np.concatenate([[0], end[pieces.ends - 1]]) * ids.itemsize).tolist()
        unfit = np.asarray(unfit)
        broken = np.concatenate([unfit, [bool(LONG_SPACE.search(x)) for x in heads]])
        whole = np.add.reduceat(broken[which].astype(np.int64), pieces.heads) > 0
        return [self.encode(column[i].as_py()).tobytes() if w else bytes(out[edge[i] : edge[i + 1]]) for i, w in enumerate(whole.tolist())]


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    """One for each worker process: the vocabulary alone."""
    return Ids(path)


def tokenized(rows: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, place, ids (bytes of little-endian unsigned numbers, ``end_id``
    last) and wide (whether they have four bytes). place is the Hilbert key
    above 32 bits of a hash of the row's id and number, which parts documents
    with one key, rows that repeat included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer_path)
        end = np.array([end_id], dtype=ids.code).tobytes()
        for batch in one_by_one(batches):
            column = batch.column("text")
            low = np.asarray(batch.column("low"), dtype=np.int64)
            for lo, hi, _, _ in text_slices(column, SLICE):
                part = column[lo:hi]
                pieces = Pieces(part)
                packed = [x + end for x in ids.of_column(part, pieces)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array((curve_keys(pieces) << 32) | low[lo:hi]), pa.array(packed, pa.binary()), pa.array([len(end) == 4] * (hi - lo))],
                    names=["doc_id", "place", "ids", "wide"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    low = F.xxhash64("doc_id", F.monotonically_increasing_id()).bitwiseAND(F.lit(0xFFFFFFFF))
    return rows.select("doc_id", "text", low.alias("low")).mapInArrow(run, f"doc_id {kind}, place bigint, ids binary, wide boolean")


def balanced(cells: np.ndarray, sizes: np.ndarray, target: float) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, first bin, bins) of each cell, and the number of bins: cells in
    order share a bin of at most ``target``, and a larger cell has several."""
    out, at, held = [], 0, 0
    for cell, size in sorted(zip(cells.tolist(), sizes.tolist())):
        if held and held + size > target:
            at, held = at + 1, 0
        many = max(1, int(-(-size // target)))
        out.append((cell, at, many))
        if many > 1:
            at += many
        else:
            held += size
    return out, at + 1


def with_bins(table: DataFrame, bins: int) -> tuple[DataFrame, int]:
    """``table`` with bin, a range of places, and the number of bins: about
    ``bins`` with equally many ids each. Ids are summed by the first
    ``CELL_BITS`` bits of the place; rows of a cell with more than a bin's
    share are dealt to its bins by their hashes."""
    cell = F.shiftright("place", DIMS * BITS + 32 - CELL_BITS).cast("int")
    sums = table.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("ids")).alias("size")).toArrow()  # a row a cell at most
    sizes = sums["size"].to_numpy()
    placed, many = balanced(sums["cell"].to_numpy(), sizes, max(1.0, float(sizes.sum()) / bins))
    index = table.sparkSession.createDataFrame(placed, "cell int, first int, many int")
    part = F.shiftright(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)) * F.col("many"), 32)
    dealt = table.withColumn("cell", cell).join(F.broadcast(index), "cell").withColumn("bin", F.col("first") + part.cast("int"))
    return dealt.drop("cell", "first", "many"), many


def _cut(pieces: list[tuple], total: int) -> Iterator[list[tuple]]:
    """Cut an unfinished sequence into sequences whose lengths are powers of
    two, largest first: they need no padding."""
    while total:
        size = 1 << (total.bit_length() - 1)
        now, need = [], size
        while need:
            doc, start, ids, n = pieces.pop(0)
            take = min(need, len(ids))
            now.append((doc, start, ids[:take], n))
            if take < len(ids):
                pieces.insert(0, (doc, start + take, ids[take:], n))
            need -= take
        total -= size
        yield now


def pack(documents: DataFrame, *, tokenizer_path: str, key: str = "doc_id", text: str = "text", length: int = 1024, end_id: int = 0, bins: int | None = None) -> DataFrame:
    """Pack every document into sequences of ``length`` tokens along the curve.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and ids (array of int). Documents are cut where a sequence is full;
    the last tokens of each of about ``bins`` ranges of the curve (the shuffle
    partitions unless given) go to sequences whose lengths are powers of two,
    so nothing is padded.

    A null or empty text is the end token alone; a text longer than a sequence
    fills several; rows that repeat, and rows with equal or null ids, are packed
    as often as they occur, in no fixed order; an empty table gives no rows;
    extra columns are ignored. A range of the curve is the unit of work, and
    documents with one key are parted by a hash of id and row.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = keyed_rows(documents, key, text)
    bins = bins or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, as all places are looked at before rows are dealt out.
    dealt, many = with_bins(written(tokenized(rows, tokenizer_path, end_id)), bins)
    sorted_rows = dealt.repartitionById(many, "bin").sortWithinPartitions("bin", "place", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        open_pieces: list[tuple] = []
        filled, at, serial = 0, 0, 0

        def close(pieces: list[tuple]) -> None:
            nonlocal serial
            offset = 0
            for doc, start, ids, n in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, (at << 40) + serial, offset, ids))
                offset += len(ids)
            serial += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 8
            ids = cols[7]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            arrays = [pa.array(list(cols[0]), doc_type), *(pa.array(list(c), pa.int64()) for c in cols[1:7]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in one_by_one(batches):
            doc_type = batch.schema.field("doc_id").type
            for doc, bin_no, raw, wide in zip(batch.column("doc_id").to_pylist(), batch.column("bin").to_pylist(), batch.column("ids"), batch.column("wide").to_pylist()):
                if bin_no != at:
                    for part in _cut(open_pieces, filled):
                        close(part)
                    open_pieces, filled, at, serial = [], 0, bin_no, 0
                ids = np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2")
                start, n = 0, len(ids)
                while start < n:
                    take = min(length - filled, n - start)
                    open_pieces.append((doc, start, ids[start : start + take], n))
                    filled += take
                    start += take
                    if filled == length:
                        close(open_pieces)
                        open_pieces, filled = [], 0
                if len(out) >= 4096:
                    yield flush()
            open_pieces = [(d, s, i.copy(), n) for d, s, i, n in open_pieces]
            if out:
                yield flush()
        for part in _cut(open_pieces, filled):
            close(part)
        if out:
            yield flush()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return sorted_rows.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>")
