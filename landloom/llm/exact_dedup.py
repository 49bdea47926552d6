"""Exact deduplication by 128-bit content hash with a comparison of bytes inside each hash group.

The 128-bit hash leads the grouping key and the normalised text follows it, so Spark's aggregation
compares the bytes of rows whose hashes agree: two texts that collide stay two groups. Copies are
combined before the shuffle (one row for each distinct text of a task), so a text that a third of
all rows repeat costs one row a task. Only hashes travel in the join that tells each row its group.
Rows that stay travel beside their key, so they hold the places of their capitals in place of a second text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import ascii_lower, materialise


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty
    texts form one group. keep: which id of a group stays, "min" (the smallest, stable under growth)
    or "max". A null id never wins against another; alone it keeps its row (keep_id null, kept true).
    Rows that repeat an id are reported each. An empty table gives an empty result; other columns
    of docs are not read, whatever their names.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("t")).select("doc_id", F.md5("t").alias("h"), F.sha2("t", 256).alias("s"), "t")
    groups = rows.groupBy("h", "t").agg(F.first("s").alias("s"), best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Two texts of one 128-bit hash would differ in the 256-bit one; the join compares both.
    groups = materialise(groups.filter("group_size > 1").select("h", F.col("s").alias("s2"), "keep_id", "group_size"), "exact")
    rows = rows.select("doc_id", "h", "s")
    out = rows.join(groups, (rows.h == groups.h) & (rows.s == groups.s2), "left")
    one = F.col("group_size").isNull()
    keep_id = F.when(one, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("s").alias("text_sha256"))


def gaps_of(text: bytes) -> bytes:
    """The gaps between the capitals A-Z of a text and from the last one to its end: 255 for each 255 bytes, then a smaller rest.

    Of texts that differ in case only, the smaller one has the smaller gaps.
    """
    b = np.frombuffer(text, np.uint8)
    gap = np.diff(np.append(np.flatnonzero((b >= 65) & (b <= 90)), len(b)), prepend=0)
    whole, rest = np.divmod(gap, 255)
    out = np.full(whole.sum() + len(gap), 255, np.uint8)
    out[np.cumsum(whole + 1) - 1] = rest
    return out.tobytes()


def with_gaps(lower: bytes, gaps: bytes) -> bytes:
    """The text that gaps_of() got, from its lower-case form."""
    b, g = np.frombuffer(lower, np.uint8).copy(), np.frombuffer(gaps, np.uint8)
    b[np.cumsum(g, dtype=np.int64)[g < 255][:-1]] -= 32
    return b.tobytes()


@F.arrow_udf(BinaryType())
def case_of(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else gaps_of(x) for x in text.cast(pa.binary()).to_pylist()], pa.binary())


@F.arrow_udf(StringType())
def cased(lower: pa.Array, case: pa.Array) -> pa.Array:
    pairs = zip(lower.cast(pa.binary()).to_pylist(), case.to_pylist(), strict=True)
    return pa.array([None if g is None else with_gaps(t, g) for t, g in pairs], pa.binary()).cast(pa.string(), safe=False)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of equal texts the row with the smallest id, all columns as they were.

    Of rows that repeat both id and text one stays (ties: the smallest remaining columns). A null id
    stays only where no row of its group has an id.
    """
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    t, i = ascii_lower(F.col(text_col)), F.col(id_col)
    held = [case_of(c) if f.name == text_col else c for c, f in zip(columns, docs.schema, strict=True)]
    rows = docs.select(F.md5(t).alias("h"), t.alias("t"), F.struct(i.isNull().alias("none"), i.alias("id")).alias("first"), F.struct(*[c.alias(f"c{k}") for k, c in enumerate(held)]).alias("row"))
    plain = lambda f: "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"
    rest = [F.col(f"row.c{k}") if plain(f) else F.col(f"row.c{k}").cast("string") for k, f in enumerate(docs.schema) if f.name != id_col]
    order = F.struct("first", *[c.alias(f"c{k}") for k, c in enumerate(rest)])
    best = rows.groupBy("h", "t").agg(F.min_by("row", order).alias("row"))
    return best.select(*[(cased(F.col("t"), F.col(f"row.c{k}")) if c == text_col else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(docs.columns)])
