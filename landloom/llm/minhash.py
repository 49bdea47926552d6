"""Near-duplicate detection: circulant MinHash, banding, exact confirmation, components.

Every text becomes the set of its distinct word shingles (64-bit hashes). One permutation places each
shingle on a ring of 2^32 places; a second one, shifted by k places around the ring, gives coordinate k
of the signature, so two permutations generate all coordinates. Bands of coordinates propose
candidates, and a link counts only if the full sets confirm it.

Documents with the same set form a class, which one representative (the smallest id) stands for; only
representatives are compared. Inside a bucket of a band, rows meet a pivot, not each other:
  round 1 compares every member with the bucket's smallest member; later rounds use other pivots, and
  only in buckets whose members still lie in several components, for members outside the pivot's one;
  what is still open then is settled exactly by prefixes: with the shingles of each set in one order,
  rare ones first, two sets can only be similar enough if a shingle is in the first places of both, and
  early enough in both for the rest to suffice. Only such pairs of different components are compared.
So no link between different components is left out, and a bucket of one component, or one whose members
differ in shingles of their own, costs a few rows a member, however large it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, id_back, id_text, materialise
from .components import components

BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
CHUNK = 1 << 15  # shingles worked on at once: they stay in the cache
WORDS_KEPT = 500_000
SLOTS = 1 << 17
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
R1, R2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


class Words(dict):
    """word -> 64-bit hash, kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, k: int, known: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words: the whole sequence is one; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    n = max(len(h) - k + 1, 1)
    s = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(k, len(h))):
        s = mix(s * M1 + h[i : i + n])
    return np.unique(s)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES minima for each set (not empty)."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= CHUNK):
            n += len(sets[to])
            to += 1
        s = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *map(len, sets[at : to - 1])])
        out[at:to] = minima(s, starts)
        at = to
    return out


def minima(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    place = (mix(s * M3) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    scaled = place * R1  # (place + k) * R1 = place * R1 + k * R1
    x, y = np.empty_like(scaled), np.empty_like(scaled)
    out = np.empty((len(starts), COORDINATES), np.uint32)
    for k in range(COORDINATES):  # the second, shifted by k
        np.add(scaled, np.uint32(k * int(R1) & 0xFFFFFFFF), out=x)
        np.right_shift(x, 15, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, R2, out=x)
        np.right_shift(x, 16, out=y)
        np.bitwise_xor(x, y, out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys; a band's number is part of its key."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * M1 + sig[:, b * ROWS + r])
        out[:, b] = h
    return out.view(np.int64)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, set_key (128 bits of the set), bands (null for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for part in batches:
            for at in range(0, len(part), 512):
                own = part.iloc[at : at + 512]
                sets = [shingles(t, k, known) for t in own["t"]]
                some = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                if some:
                    for i, row in zip(some, bands_of(signatures([sets[i] for i in some])), strict=True):
                        bands[i] = row
                yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "n": [len(s) for s in sets], "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], "bands": bands})

    return id_back(docs.withColumn("doc_id", id_text(F.col("doc_id"))).mapInPandas(run, "doc_id string, n long, set_key binary, bands array<long>"), "doc_id")


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and set (sorted 64-bit hashes as bytes) of the documents in ids (one column, id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for part in batches:
            for at in range(0, len(part), 512):
                own = part.iloc[at : at + 512]
                yield pd.DataFrame({"id": own["doc_id"].to_numpy(), "s": [shingles(t, k, known).tobytes() for t in own["t"]]})

    found = docs.join(ids, docs.doc_id == ids.id, "left_semi")
    return found.mapInPandas(run, "id long, s binary")


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b) with link: den * intersection >= num * union on the full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            link = []
            for x, y in zip(part["sa"], part["sb"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                link.append(den * both >= num * (len(p) + len(q) - both))
            yield pd.DataFrame({"a": part["a"], "b": part["b"], "link": link})

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long, link boolean")


def sharing_prefixes(rest: DataFrame, num: int, den: int) -> DataFrame:
    """rest (rep, label, s) -> pairs (a, b) of different labels that may be linked; none that is linked is missing.

    The order of shingles follows counts in SLOTS slots, so that what the tasks share has a fixed size.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for part in batches:
            for s in part["s"]:
                np.add.at(total, (np.frombuffer(s, np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
        some = np.nonzero(total)[0]
        yield pd.DataFrame({"slot": some, "c": total[some]})

    counts = np.zeros(SLOTS, np.int64)
    for r in rest.select("s").mapInPandas(count, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).collect():  # SLOTS rows at most
        counts[r["slot"]] = r["c"]
    shared = rest.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value
        for part in batches:
            out = []
            for rep, label, s in zip(part["rep"], part["label"], part["s"], strict=True):
                own = np.frombuffer(s, np.uint64)
                n = len(own)
                take = n - -(-num * n // den) + 1
                order = np.lexsort((own, common[(own % np.uint64(SLOTS)).astype(np.int64)]))[:take]
                out.append(pd.DataFrame({"token": own[order].view(np.int64), "place": np.arange(len(order)), "rep": rep, "label": label, "n": n}))
            if out:
                yield pd.concat(out)

    rows = materialise(rest.mapInPandas(first, "token long, place int, rep long, label long, n long"), "prefixes")
    by_label = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = by_label.groupBy("token").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label")).alias("m")).filter("labels > 1")
    mixed = materialise(mixed.select("token", F.col("m.label").alias("most")), "tokens")
    rows = materialise(rows.join(mixed, "token"), "rows")
    # Of two labels at a token one is not its most frequent one: that one looks for the others.
    one = rows.filter("label <> most").select("token", F.col("rep").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("place").alias("px"))
    two = rows.select("token", F.col("rep").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("place").alias("py"))
    # The first shingle that both share leaves room for at most this many.
    room = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    enough = (num + den) * room >= num * (F.col("nx") + F.col("ny"))
    pairs = one.join(two, "token").filter("lx <> ly").filter(enough)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", pivot_rounds: int = 2) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII blanks after lower-casing A-Z; documents are linked when
    den * intersection >= num * union of their shingle sets. Null and empty texts have an empty set
    and no link; equal sets are linked. component_id is the smallest id in reach, kept says that it
    is the document's own. Of rows that repeat an id each is placed by its
    own text; where the id stands for several texts, it is linked by any of them. A document with a null id is its own component (component_id null) and kept.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    seen = materialise(describe(src, k), "shingles")
    some = seen.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialise(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("bands").alias("bands")), "classes")
    members = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    pivots = members.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    pivots = materialise(pivots, "pivots")
    # Only rows of buckets with two members at least go on.
    members = materialise(members.join(pivots.select("bucket", "pivot"), "bucket"), "members")
    ids = materialise(members.select(F.col("rep").alias("id")).distinct(), "ids")
    sets = materialise(full_sets(src, ids, k).dropDuplicates(["id", "s"]), "sets")
    fits = lambda x, y: den * F.least(x, y) >= num * F.greatest(x, y)  # noqa: E731  sets of other sizes can't be so similar

    sizes = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"))
    first = members.filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("na")).distinct()
    first = first.join(sizes, "b").filter(fits(F.col("na"), F.col("nb"))).select("a", "b")
    tested = materialise(confirmed(first, sets, num, den), "tested")
    done = [tested]
    labels = components(tested.filter("link").select("a", "b"))

    def united() -> DataFrame:
        out = done[0]
        for x in done[1:]:
            out = out.union(x)
        return out

    def placed() -> DataFrame:
        """The members of buckets that still lie in several components."""
        now = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("bucket", "rep", "n", F.coalesce("label", "rep").alias("label"))
        now = materialise(now, "placed")
        open_ = materialise(now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("rep", "n", "label"), F.xxhash64("rep", F.lit(len(done)))).alias("p")).filter("lo < hi").select("bucket", "p"), "open")
        out = materialise(now.join(open_, "bucket"), "left")
        forget(now)
        return out

    def link(pairs: DataFrame) -> None:
        nonlocal labels
        before = united().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = materialise(pairs.join(before, ["a", "b"], "left_anti"), "pairs")
        new = materialise(confirmed(pairs, sets, num, den), "tested")
        done.append(new)
        if new.filter("link").limit(1).count():
            old = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
            labels = components(old.union(new.filter("link").select("a", "b")))

    for turn in range(pivot_rounds):
        left = placed()
        one = left.filter("label <> p.label").filter(fits(F.col("n"), F.col("p.n"))).groupBy("rep").agg(F.min_by("p.rep", F.xxhash64("bucket", F.lit(turn))).alias("p"))
        link(one.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct())
        forget(left)
    left = placed()
    rest = materialise(left.select("rep", "label").distinct().join(sets.withColumnRenamed("id", "rep"), "rep"), "rest")
    link(sharing_prefixes(rest, num, den))
    forget(left, rest)
    forget(members, ids, sets, pivots)
    to = classes.select("set_key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("label", "rep").alias("component"))
    to = materialise(to, "membership")
    out = seen.select("doc_id", "n", "set_key").join(to, "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
