"""Fill-in-middle transformation with a sparse checkpoint index.

A text is cut by code points, but lies in memory as UTF-8 bytes. While the code points are counted, the
number of those before every STEP-th byte is recorded; a cut is then found by binary search among
these checkpoints and a look at the STEP bytes after one of them. Nothing is decoded, and the index takes a
small part of the text's own memory, so very long texts cost a pass over their bytes and no more. Rows stay in
their partitions: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import begins, utf8

STEP = 1024  # bytes between checkpoints
SLICE = 1 << 20  # bytes counted at once
OUT_BYTES = 16 << 20  # bytes of output handed on at once
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")


class Checkpoints:
    """The code points before every STEP-th byte of a text, and their number n."""

    def __init__(self, data: np.ndarray, step: int = STEP):
        self.data, self.step = data, step
        counts = [np.zeros(1, np.int64)]
        a_slice = max(1, SLICE // step) * step
        for at in range(0, len(data), a_slice):
            first = begins(data[at : at + a_slice])
            counts.append(np.add.reduceat(first, np.arange(0, len(first), step), dtype=np.int64))
        self.before = np.cumsum(np.concatenate(counts))
        self.n = int(self.before[-1])

    def byte(self, cut: int) -> int:
        """The byte at which code point number cut begins; the text's end for cut = n."""
        if cut >= self.n:
            return len(self.data)
        k = int(np.searchsorted(self.before, cut, "right")) - 1
        at = k * self.step
        return at + int(np.flatnonzero(begins(self.data[at : at + self.step]))[cut - self.before[k]])


def transformed(data: np.ndarray, h: tuple[int, int, int, int], plain_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    index, text = Checkpoints(data), data.tobytes()
    n = index.n
    p, s, m = (x.encode() for x in SENTINELS)
    if not n or h[2] % 100 >= 100 - plain_percent or p in text or s in text or m in text:
        return n, "plain", None, None, text
    cuts = sorted(x % (n + 1) for x in h[:2])
    a, b = map(index.byte, cuts)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", cuts[0], cuts[1] - cuts[0], b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", cuts[0], cuts[1] - cuts[0], b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 10, spm_percent: int = 20, salt: str = "1:") -> DataFrame:
    """One row a document: doc_id, n (code points), form, prefix_chars, middle_chars, output.

    The cuts and the form follow from the SHA-256 of salt and the id, so a document is cut alike in every
    run. Texts that are empty or null, or hold a sentinel's string, stay plain (lengths null, the output is the text). Cuts may
    fall together or on an end: parts are then empty. Equal ids are cut by equal numbers; a null id counts as
    an empty one. An empty table gives no rows; other columns of docs are not read, whatever their names.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data, at = utf8(part.column("t"))
            h = [part.column(f"h{k}").to_pylist() for k in range(4)]
            ids, rows, held = part.column("doc_id").to_pylist(), [], 0
            for i, row in enumerate(zip(*h, strict=True)):
                rows.append((ids[i], *transformed(data[at[i] : at[i + 1]], row, plain_percent, spm_percent)))
                held += len(rows[-1][-1])
                if held >= OUT_BYTES or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0

    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select("doc_id", "t", *numbers)
    out = src.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, raw binary")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("raw").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone. A sentinel's string can't begin inside another, so the first found is the one put in."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.split(output, second, 2)
        tail = F.split(head[1], MIDDLE, 2)
        return F.substr(head[0], F.lit(len(first) + 1)), tail[0], tail[1]

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
