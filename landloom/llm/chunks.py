"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text's bytes are cut where the gear hash of the last 32 bytes has its six highest bits clear, so a cut
depends on its neighbourhood only and an insertion moves the cuts around it, not those after it. Chunks
have MIN to MAX bytes and never part a character. A chunk stays where its digest occurs first (smallest
document id, then place); every later occurrence is removed. Occurrences meet only in sums that are
combined before the shuffle and in a join that Spark may split, so a chunk that a third of all
documents hold does not gather in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, id_back, id_text, materialise

MIN, MAX, TOP_BITS = 32, 512, 6
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(b: np.ndarray) -> np.ndarray:
    """The gear hash (32 bits) after each byte: the sum of GEAR[byte j back] << j over the last 32 bytes, by doubling."""
    h = GEAR[b]
    for m in (1, 2, 4, 8, 16):
        up = np.left_shift(h[:-m], np.uint32(m))
        h = h.copy()
        h[m:] += up
    return h


def cuts(b: np.ndarray, can: np.ndarray | None = None) -> list[int]:
    """The ends of the chunks of one text's bytes; the last end is its length. can: places where the hash allows a cut."""
    n = len(b)
    if n <= MIN:
        return [n] if n else []
    if can is None:
        can = np.nonzero(gear(b) >> np.uint32(32 - TOP_BITS) == 0)[0] + 1
    can = can[can < n]
    can = can[(b[can] & 0xC0) != 0x80]
    out, at = [], 0

    def fill(to: int) -> None:
        nonlocal at
        while to - at > MAX:
            end = at + MAX
            while b[end] & 0xC0 == 0x80:
                end -= 1
            out.append(end)
            at = end

    for c in can.tolist():
        if c - at >= MIN:
            fill(c)
            if c - at >= MIN:
                out.append(c)
                at = c
    fill(n)
    if at < n:
        out.append(n)
    return out


def chunk_rows(rows: DataFrame) -> DataFrame:
    """rows (doc_id, tk, t) -> one row a chunk: doc_id, tk, start, size and its 128-bit digest as two longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            ids, tks, starts, sizes, digests = [], [], [], [], []
            for d, tk, t in zip(part["doc_id"].to_list(), part["tk"].to_list(), part["t"].to_list(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                ends = cuts(np.frombuffer(raw, np.uint8))
                begins = [0, *ends[:-1]]
                ids.append(np.full(len(ends), d, np.int64))
                tks.append(np.full(len(ends), tk, np.int64))
                starts += begins if ends else []
                sizes += [e - s for s, e in zip(begins, ends, strict=False)]
                digests += [hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(begins, ends, strict=False)]
                if len(starts) > 100_000:
                    yield frame(ids, tks, starts, sizes, digests)
                    ids, tks, starts, sizes, digests = [], [], [], [], []
            if starts:
                yield frame(ids, tks, starts, sizes, digests)

    def frame(ids, tks, starts, sizes, digests) -> pd.DataFrame:
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return pd.DataFrame({"doc_id": np.concatenate(ids), "tk": np.concatenate(tks), "start": starts, "size": sizes, "d0": d[:, 0], "d1": d[:, 1]})

    return rows.mapInPandas(run, "doc_id long, tk long, start int, size int, d0 long, d1 long")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), n_chunks, n_repeated, text (what is left).

    Null text counts as empty. A row with a null id keeps its whole text and takes no part. Rows that
    repeat an id and a text share their first occurrence and stay; of rows that repeat an id with
    different texts each is handled by itself. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("tk", F.xxhash64("t"))
    chunks = materialise(chunk_rows(rows.filter("doc_id IS NOT NULL")), "chunks")
    often = chunks.groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "tk", "start")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("d0", "d1", "first")
    often = materialise(often, "often")
    again = chunks.join(often, ["d0", "d1"]).filter("struct(doc_id, tk, start) <> first").select("doc_id", "tk", "start", "size").distinct()
    spans = materialise(again.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "size")).alias("spans")), "spans")
    counts = materialise(chunks.groupBy("doc_id", "tk").agg(F.countDistinct("start").alias("n_chunks")).withColumnRenamed("doc_id", "i").withColumnRenamed("tk", "k"), "counts")
    forget(chunks, often)
    info = counts.join(spans.withColumnRenamed("doc_id", "i2").withColumnRenamed("tk", "k2"), (F.col("i") == F.col("i2")) & (F.col("k") == F.col("k2")), "left").select("i", "k", "n_chunks", "spans")
    joined = rows.join(info, (rows.doc_id == F.col("i")) & (rows.tk == F.col("k")), "left")
    return without_spans(joined)


def without_spans(joined: DataFrame) -> DataFrame:
    """rows (doc_id, t, spans to remove, n_chunks) -> the result of substring_dedup."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for d, t, spans, n in zip(part["doc_id"].to_list(), part["t"].to_list(), part["spans"].to_list(), part["n_chunks"].to_list(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                kept, at, runs, gone = [], -1, 0, 0
                pos = 0
                found = sorted((x["start"], x["size"]) for x in spans) if spans is not None else []
                for s, size in found:
                    runs += s != at
                    kept.append(raw[pos:s])
                    gone += size
                    pos = at = s + size
                kept.append(raw[pos:])
                out.append((d, len(raw), gone, runs, n, len(found), b"".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "n_chunks", "n_repeated", "text"])

    src = joined.select(id_text(F.col("doc_id")).alias("doc_id"), "t", "spans", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    return id_back(src.mapInPandas(run, "doc_id string, n_bytes long, n_removed long, n_spans long, n_chunks long, n_repeated long, text string"), "doc_id")
