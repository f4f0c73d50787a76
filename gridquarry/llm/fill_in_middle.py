"""Fill-in-the-middle rows by rotating blocks in place.

A text is cut between tokens (a run of ASCII letters, or any one other
character) at two drawn places. The three sentinels are put into its bytes in
the text's own order, prefix, middle, suffix; then neighbouring blocks are
exchanged by three reversals each: middle and suffix for both forms, and for
``spm`` prefix and suffix too. Restoring rotates back and takes the sentinels
out, from the output and its form alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import one_by_one
from .textbytes import text_slices

# The sentinels.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True


def token_starts(data: np.ndarray) -> np.ndarray:
    """Where the tokens of UTF-8 bytes begin."""
    letter = _IS_LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def _reverse(view: np.ndarray, lo: int, hi: int) -> None:
    half = (hi - lo) // 2
    left = view[lo : lo + half].copy()
    view[lo : lo + half] = view[hi - half : hi][::-1]
    view[hi - half : hi] = left[::-1]


def rotate(buffer: bytearray, lo: int, cut: int, hi: int) -> None:
    """Exchange the blocks ``lo`` to ``cut`` and ``cut`` to ``hi`` in place."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, lo, cut)
    _reverse(view, cut, hi)
    _reverse(view, lo, hi)


def cut_and_rotate(text: bytes, first: int, second: int, form: str) -> bytearray:
    """``text`` cut at the bytes ``first`` <= ``second``, in form psm or spm."""
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = first + 3, second + 6
    rotate(buffer, middle, suffix, len(buffer))
    if form == "spm":
        rotate(buffer, 0, middle, middle + len(buffer) - suffix)
    return buffer


def restored(output: bytes, form: str) -> bytearray:
    """The text of an output: rotations back, sentinels out."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    if form == "spm":
        rotate(buffer, 0, buffer.index(PREFIX), buffer.index(MIDDLE))
    suffix, middle = buffer.index(SUFFIX), buffer.index(MIDDLE)
    rotate(buffer, suffix, middle, len(buffer))
    middle, suffix = suffix, suffix + len(buffer) - middle
    del buffer[suffix : suffix + 3], buffer[middle : middle + 3], buffer[:3]
    return buffer


def _strings(values: list[bytes | bytearray], like: pa.DataType) -> pa.Array:
    return pa.array([bytes(v) for v in values], pa.binary() if pa.types.is_string(like) else pa.large_binary()).cast(like)


def fill_in_middle(documents: DataFrame, *, key: str = "doc_id", text: str = "text", salt: str = "1", cut_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """One row a row of ``documents``: doc_id, n (tokens), form (plain, psm or
    spm), prefix_chars and middle_chars (code points; null if plain), output.

    The draws are the first four groups of eight hex digits of the SHA-256 of
    ``salt``, a colon and the id, so a row's output depends on that row alone:
    rows with equal ids are cut at the same fractions, a null id counts as the
    empty text. Null and empty texts are plain and empty, texts that hold a
    sentinel stay plain; a long text is cut whole, in one buffer of its size.
    Of two equal cuts the middle is empty. An empty table gives none; extra
    columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(documents[key].cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]
    rows = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            h1, h2, h3, h4 = (np.asarray(batch.column(f"h{i}")) for i in range(1, 5))
            kind = batch.column("text").type
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                n, form, before, within, out = [], [], [], [], []
                for i in range(lo, hi):
                    own = data[offsets[i - lo] : offsets[i - lo + 1]]
                    raw = own.tobytes()
                    starts = token_starts(own)
                    n.append(len(starts))
                    plain = not raw or PREFIX in raw or SUFFIX in raw or MIDDLE in raw or h3[i] % 100 >= cut_percent
                    form.append("plain" if plain else "spm" if h4[i] % 100 < spm_percent else "psm")
                    if plain:
                        before.append(None), within.append(None), out.append(raw)
                        continue
                    cuts = sorted(int(h[i]) % (len(starts) + 1) for h in (h1, h2))
                    first, second = (int(starts[c]) if c < len(starts) else len(own) for c in cuts)
                    chars = (own & 0xC0) != 0x80
                    before.append(int(chars[:first].sum())), within.append(int(chars[first:second].sum()))
                    out.append(cut_and_rotate(raw, first, second, form[-1]))
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(within, pa.int64()), _strings(out, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore_text(rows: DataFrame) -> DataFrame:
    """``rows`` with restored, the text that output and form were made of; a
    null output gives null."""
    name = "restored"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            forms, outputs = batch.column("form").to_pylist(), batch.column("output")
            binary = outputs.cast(pa.binary() if pa.types.is_string(outputs.type) else pa.large_binary())
            texts = [None if (o := v.as_py()) is None else bytes(restored(o, f)) for v, f in zip(binary, forms)]
            made = pa.array(texts, binary.type).cast(outputs.type)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, {name} string")
