"""Substring deduplication over sorted suffixes.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document of smaller id. To
find these strings, suffixes are sorted by a distributed merge sort that never compares a known prefix twice:

1. The anchor of a string is the smallest, by hash, of the GRAM-byte pieces in it. Equal strings have equal
   anchors at equal places, so it is enough to sort the suffixes that start at anchors, each with those
   bytes before it that its strings hold as a second key. A first exchange compares the anchors' hashes,
   delta-coded, and tells each run which of its anchors other documents have too (and which very many have).
2. Documents are dealt to runs. A run sorts its suffixes; one that it holds twice stays with its smallest
   document only, for the others are covered wholly. The sorted run is front-coded: the length of the
   prefix shared with the one before, and the rest.
3. Each range of anchors merges its runs with a loser tree that carries these lengths, which decides most
   duels without looking at a byte. In the merged order the strings that contain an anchor at a given
   place are neighbours up to the bytes before it, whose ranks are compared too; the smallest document of
   each string is noted, and all others' bytes are covered. Everything is decided by bytes, hashes only filter.

An anchor that very many documents have is parted before the exchange: each of its strings goes as a suffix of
its own to a range chosen by the whole string, where a run sends any string once.

All steps are one plan. The texts are exchanged once, by run, and that exchange is read by three steps. A
run and a range exchange a row only if they have anchors in common, so there are never more rows than anchors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, GRAM = 50, 16
PLACES = LENGTH - GRAM + 1  # of an anchor in a string; also pieces a string has
BEFORE = PLACES - 1  # bytes before an anchor that a string can have
WIDTH = LENGTH + BEFORE
PAD = 255  # never a byte of UTF-8
RUN_BYTES, LARGEST_RUN = 8 << 20, 256 << 20
BATCH_BYTES = 1 << 20
HOT = 20_000  # documents of one anchor from which on its strings are sent one by one
BASE = 0x9E3779B97F4A7C15


def stepped(op: np.ufunc, x: np.ndarray, n: int, back: bool) -> np.ndarray:
    """op over n neighbours from each place on (or up to it, with back), by doubling."""
    m, size = 1, len(x)
    while m < n:
        d = min(m, n - m)
        y = x.copy()
        if back:
            op(x[d:], x[: size - d], out=y[d:])
        else:
            op(x[: size - d], x[d:], out=y[: size - d])
        x, m = y, m + d
    return x


def piece_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on, odd, so not 0."""
    n = len(b)

    def join(h: np.ndarray, m: int, g: np.ndarray, k: int) -> np.ndarray:
        out = h * np.uint64(pow(BASE, k, 1 << 64))
        out[: n - m] += g[m:]
        return out

    powers = {1: b.astype(np.uint64) + np.uint64(1)}
    m = 1
    while 2 * m <= GRAM:
        powers[2 * m] = join(powers[m], m, powers[m], m)
        m *= 2
    h, size = powers[m], m
    for k in sorted(powers, reverse=True):
        if size + k <= GRAM:
            h, size = join(h, size, powers[k], k), size + k
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)) | np.uint64(1)


def anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: places and hashes of the anchors, and the first and last place of the anchor in its strings.

    Strings never cross an end. A string whose smallest hash stands at several places belongs to the anchor of each.
    """
    if len(b) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = piece_hashes(b)
    least = stepped(np.minimum, h, PLACES, back=False)
    edge = np.zeros(len(b) + 1, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    np.add.at(edge, np.maximum(starts, ends - (LENGTH - 1)), 1)
    np.add.at(edge, ends, -1)
    least[np.cumsum(edge[:-1]) > 0] = 0  # no string starts here
    at = np.nonzero(h == stepped(np.maximum, least, PLACES, back=True))[0]
    low, high = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for i in range(0, len(at), 1 << 15):
        own = at[i : i + (1 << 15)]
        place = own[:, None] - np.arange(PLACES)
        mine = (least[np.maximum(place, 0)] == h[own][:, None]) & (place >= 0)
        low[i : i + len(own)], high[i : i + len(own)] = mine.argmax(1), PLACES - 1 - mine[:, ::-1].argmax(1)
    # Anchors' hashes are the small ones; mixed again they spread over all ranges.
    h = (h[at] ^ (h[at] >> np.uint64(31))) * np.uint64(BASE)
    return at, h ^ (h >> np.uint64(29)), low, high


def planes(x: np.ndarray) -> bytes:
    """Integers of one sign byte plane by byte plane, as many as the largest needs; small numbers compress well."""
    x = np.asarray(x)
    size = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8) if x.min(initial=0) >= 0 else 8
    return bytes([size]) + np.ascontiguousarray(x.astype("<u8" if x.dtype.kind == "u" else "<i8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    size = raw[0]
    n = (len(raw) - 1) // size
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, offset=1).reshape(size, n).T
    return out.view("<i8").reshape(-1)


def part_of(h: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The range that a hash of so many bits (32 at least) falls into; ranges follow the order of hashes."""
    return ((h >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def slices(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each value of a sorted array with its slice."""
    first = np.nonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])[0] if len(sorted_values) else np.zeros(0, np.int64)
    yield from zip(sorted_values[first].tolist(), first.tolist(), np.r_[first[1:], len(sorted_values)][: len(first)].tolist(), strict=True)


class Run:
    """A run's texts end to end in the order of id and text, with their anchors; equal on every node and in every step."""

    def __init__(self, docs: pd.DataFrame, bits: int):
        docs = docs.sort_values(["doc_id", "t"], kind="stable")
        self.ids = docs["doc_id"].to_numpy(np.int64)
        raw = [t.encode("utf-8", "surrogatepass") for t in docs["t"]]
        self.ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        self.starts = self.ends - [len(x) for x in raw]
        self.b = np.frombuffer(b"".join(raw), np.uint8)
        self.bits = bits

    def find(self) -> None:
        found, i = [], 0
        while i < len(self.ids):
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + BATCH_BYTES)))
            at, *rest = anchors(self.b[base : self.ends[j - 1]], self.ends[i:j] - base)
            found.append((at + base, *rest))
            i = j
        self.at, h, self.low, self.high = (np.concatenate(x) for x in zip(*found, strict=True))
        self.h = h >> np.uint64(64 - self.bits)
        self.doc = self.ids[np.searchsorted(self.ends, self.at, side="right")]
        self.distinct = np.unique(self.h)


CELLS = "part int, run int, hashes binary, docs binary"


def hash_run(docs: pd.DataFrame, bits: int, parts: int) -> pd.DataFrame:
    """A run's distinct anchor hashes by range, delta-coded, each with the number of its documents."""
    run = Run(docs, bits)
    run.find()
    order = np.argsort(run.h, kind="stable")  # within a hash by document
    h, d = run.h[order], run.doc[order]
    new = np.r_[True, h[1:] != h[:-1]][: len(h)]
    other = new.copy()
    other[1:] |= d[1:] != d[:-1]
    many = np.add.reduceat(other.astype(np.int64), np.nonzero(new)[0]) if len(h) else np.zeros(0, np.int64)
    h = h[new]
    out = [(p, int(docs["run"].iloc[0]), planes(np.diff(h[i:j], prepend=np.uint64(0))), planes(many[i:j])) for p, i, j in slices(part_of(h, bits, parts))]
    return pd.DataFrame(out, columns=["part", "run", "hashes", "docs"])


FLAGS = "run int, part int, shared binary, hot binary"


def compare_hashes(cells: pd.DataFrame, hot_from: int) -> pd.DataFrame:
    """A range's cells -> for each run which of its hashes several documents have, and which more than hot_from have."""
    if not len(cells):
        return pd.DataFrame([], columns=["run", "part", "shared", "hot"])
    hashes = [np.cumsum(from_planes(x).view(np.uint64)) for x in cells["hashes"]]
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    first = np.nonzero(np.r_[True, np.diff(h[order]) != 0])[0]
    total = np.add.reduceat(np.concatenate([from_planes(x) for x in cells["docs"]])[order], first)
    docs = np.empty(len(h), np.int64)
    docs[order] = np.repeat(total, np.diff(np.r_[first, len(h)]))
    cut = np.cumsum([0, *map(len, hashes)])
    out = [(r, p, np.packbits(docs[i:j] > 1).tobytes(), np.packbits(docs[i:j] > hot_from).tobytes()) for r, p, i, j in zip(cells["run"], cells["part"], cut, cut[1:])]
    return pd.DataFrame(out, columns=["run", "part", "shared", "hot"])


def contexts(b: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(anchors, WIDTH) bytes: those from each anchor on that its strings hold, then those before it in reverse; PAD elsewhere."""
    out = np.full((len(at), WIDTH), PAD, np.uint8)
    right, left = np.arange(LENGTH), np.arange(BEFORE)
    for i in range(0, len(at), 1 << 14):
        a, lo, hi = (x[i : i + (1 << 14), None] for x in (at, low, high))
        out[i : i + len(a), :LENGTH] = np.where(right < LENGTH - lo, b[np.minimum(a + right, len(b) - 1)], PAD)
        out[i : i + len(a), LENGTH:] = np.where(left < hi, b[np.maximum(a - 1 - left, 0)], PAD)
    return out


def order_of(s: np.ndarray) -> np.ndarray:
    """The stable order of rows of bytes."""
    return np.argsort(np.column_stack([s, np.ones(len(s), np.uint8)]).view(f"S{s.shape[1] + 1}").reshape(-1), kind="stable")  # a last byte that isn't 0


def common(s: np.ndarray) -> np.ndarray:
    """The length of the prefix that each row of sorted s shares with the row before; 0 for the first."""
    out = np.zeros(len(s), np.int64)
    for i in range(1, len(s), 1 << 16):
        j = min(i + (1 << 16), len(s))
        differ = s[i:j] != s[i - 1 : j - 1]
        out[i:j] = np.where(differ.any(1), differ.argmax(1), s.shape[1])
    return out


def settled(s: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of suffixes that come in the order of documents, and which of them repeat one of a smaller document."""
    order = order_of(s)
    s, doc = s[order], doc[order]
    first = np.nonzero(np.r_[True, (s[1:] != s[:-1]).any(1)])[0] if len(s) else np.zeros(0, np.int64)
    return order, doc > np.repeat(doc[first], np.diff(np.r_[first, len(s)]))


SORTED = "part int, run int, shared binary, tails binary, docs binary, places binary, sizes binary"
COLUMNS = [x.split()[0] for x in SORTED.split(", ")]


def spans_row(part: int, run: int, start: np.ndarray, end: np.ndarray) -> tuple:
    order = np.argsort(start)
    return (part, run, None, None, None, planes(np.diff(start[order], prepend=0)), planes((end - start)[order]))


def sort_run(docs: pd.DataFrame, flags: pd.DataFrame, bits: int, parts: int) -> pd.DataFrame:
    """A run's suffixes sorted and front-coded by range, and the spans that the run decides itself (column sizes)."""
    if not len(docs) or not len(flags):
        return pd.DataFrame([], columns=COLUMNS)
    run, me = Run(docs, bits), int(docs["run"].iloc[0])
    run.find()
    shared, hot = np.zeros(len(run.distinct), bool), np.zeros(len(run.distinct), bool)
    known = {p: (x, y) for p, x, y in zip(flags["part"], flags["shared"], flags["hot"], strict=True)}
    for p, i, j in slices(part_of(run.distinct, bits, parts)):
        for out, x in zip((shared, hot), known[p], strict=True):
            out[i:j] = np.unpackbits(np.frombuffer(x, np.uint8))[: j - i]
    which = np.searchsorted(run.distinct, run.h)
    use = np.nonzero(shared[which])[0]
    if not len(use):
        return pd.DataFrame([], columns=COLUMNS)
    at, low, high, doc, part, hot = run.at[use], run.low[use], run.high[use], run.doc[use], part_of(run.h[use], bits, parts), hot[which[use]]
    s = contexts(run.b, at, low, high)
    order, gone = settled(s, doc, at)
    out = []
    if gone.any():
        x = order[gone]
        out.append(spans_row(me % parts, me, at[x] - high[x], at[x] - low[x] + LENGTH))
    kept = order[~gone]
    few, many = kept[~hot[kept]], np.sort(kept[hot[kept]])
    if len(many):
        # Anchors of very many documents: string by string.
        width = high[many] - low[many] + 1
        start = np.repeat(at[many] - high[many], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        of = np.repeat(doc[many], width)
        later = np.lexsort((start, of))
        start, of = start[later], of[later]
        zero = np.zeros(len(start), np.int64)
        x = contexts(run.b, start, zero, zero)
        order, gone = settled(x, of, start)
        if gone.any():
            y = start[order[gone]]
            out.append(spans_row(me % parts, me, y, y + LENGTH))
        order = order[~gone]
        x, of, start = x[order], of[order], start[order]
        h = np.full(len(x), BASE, np.uint64)
        for c in range(LENGTH):
            h = (h ^ x[:, c].astype(np.uint64)) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        s, doc, at, part = np.concatenate([s[few], x]), np.concatenate([doc[few], of]), np.concatenate([at[few], start]), np.concatenate([part[few], part_of(h * np.uint64(BASE), 64, parts)])
        order = order_of(s)
    else:
        order = few
    order = order[np.argsort(part[order], kind="stable")]
    s, doc, at, part = s[order], doc[order], at[order], part[order]
    column = np.arange(WIDTH)
    for p, i, j in slices(part):
        lcp = common(s[i:j])
        out.append((p, me, lcp.astype(np.uint8).tobytes(), s[i:j][column >= lcp[:, None]].tobytes(), planes(doc[i:j]), planes(at[i:j]), None))
    return pd.DataFrame(out, columns=COLUMNS)


def decode(shared: bytes, tails: bytes) -> tuple[list[bytes], list[int]]:
    """A front-coded run."""
    out, prev, at = [], b"", 0
    lcps = list(shared)
    for n in lcps:
        to = at + WIDTH - n
        prev = prev[:n] + tails[at:to]
        out.append(prev)
        at = to
    return out, lcps


def loser_tree(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs (strings, lengths shared with the one before): run and place of each output, and what it shares with the one before.

    A node holds the loser of its duel and how much it shares with the winner that passed. Both sides of a duel share
    a known length with the last output: the longer one is the smaller string, and only equal lengths call for a
    look at bytes, from there on. Ties go to the smaller run.
    """
    k = 1
    while k < len(runs):
        k *= 2
    end = bytes([255]) * (WIDTH + 1)
    heads = [r[0][0] if r[0] else end for r in runs] + [end] * (k - len(runs))
    places = [0] * k
    total = sum(len(r[0]) for r in runs)
    from_bytes = int.from_bytes

    def duel(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and its length, loser and what it shares with the winner."""
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        x, y = heads[a], heads[b]
        if x is end or y is end:
            return (b, lb, a, 0) if x is end and y is not end else (a, la, b, 0)
        if x == y:
            return (a, la, b, WIDTH) if a < b else (b, lb, a, WIDTH)
        d = from_bytes(x[la:], "big") ^ from_bytes(y[la:], "big")
        n = WIDTH - (d.bit_length() + 7 >> 3)
        return (a, la, b, n) if x[n] < y[n] else (b, lb, a, n)

    loser, kept = [0] * k, [0] * k
    level = [(i, 0) for i in range(k)]
    node = k
    while len(level) > 1:
        node //= 2
        nxt = []
        for i in range(0, len(level), 2):
            w, lw, lo, ll = duel(*level[i], *level[i + 1])
            loser[node + i // 2], kept[node + i // 2] = lo, ll
            nxt.append((w, lw))
        level = nxt
    win, lcp = level[0]
    from_run, from_place, shares = [], [], []
    for _ in range(total):
        from_run.append(win)
        at = places[win]
        from_place.append(at)
        shares.append(lcp)
        at += 1
        strings, lcps = runs[win]
        places[win] = at
        if at < len(strings):
            heads[win], lcp = strings[at], lcps[at]
        else:
            heads[win], lcp = end, -1
        n = win + k >> 1
        while n:
            other = kept[n]
            if other > lcp:
                win, loser[n] = loser[n], win
                kept[n], lcp = lcp, other
            elif other == lcp:
                win, lcp, loser[n], kept[n] = duel(win, lcp, loser[n], other)
            n >>= 1
    return from_run, from_place, shares


def covered(s: np.ndarray, lcp: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For merged suffixes: the first and last place of the anchor in strings that a smaller document has too (last < first: none)."""
    right, left = (s[:, :LENGTH] != PAD).sum(1), (s[:, LENGTH:] != PAD).sum(1)
    # Equal contexts: all but those of the smallest document are covered wholly; one of these speaks for the rest.
    same = np.cumsum(lcp < WIDTH) - 1
    first = np.nonzero(lcp < WIDTH)[0]
    least = np.minimum.reduceat(doc, first)
    low, high = np.full(len(first), PLACES), np.full(len(first), -1)
    # Only anchors with several contexts of different documents have more to say.
    shared = lcp[first]  # with the context before
    group = np.nonzero(shared < GRAM)[0]
    some = np.maximum.reduceat(least, group) != np.minimum.reduceat(least, group)
    use = np.nonzero(some[np.cumsum(shared < GRAM) - 1])[0]
    if len(use):
        x, r, lf, d = s[first[use]], right[first[use]], left[first[use]], least[use]
        back = order_of(x[:, LENGTH:])
        alike = common(x[back, LENGTH:])
        before = np.empty(len(use), np.int64)
        for o in range(PLACES):
            ok = np.nonzero((lf >= o) & (r >= LENGTH - o))[0]
            if len(ok) < 2:
                continue
            before[back] = np.cumsum(alike < o)
            key = np.cumsum(shared < LENGTH - o)[use][ok] * (len(use) + 1) + before[ok]
            order = np.lexsort((d[ok], key))
            key = key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            smallest = d[ok[order]][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            hit = use[ok[order[d[ok[order]] > smallest]]]
            low[hit], high[hit] = np.minimum(low[hit], o), np.maximum(high[hit], o)
    low, high = low[same], high[same]
    whole = doc > least[same]
    return np.where(whole, LENGTH - right, low), np.where(whole, left, high)


SPANS = "run int, starts binary, sizes binary"


def merge_part(part: pd.DataFrame) -> pd.DataFrame:
    """A range's sorted runs -> spans by run; spans that a run decided pass through."""
    through = part["sizes"].notna()
    out = [(int(r.run), r.places, r.sizes) for r in part[through].itertuples()]
    part = part[~through].sort_values("run")
    if len(part):
        runs = [decode(a, b) for a, b in zip(part["shared"], part["tails"], strict=True)]
        from_run, from_place, lcp = (np.array(x, np.int64) for x in loser_tree(runs))
        flat = np.cumsum([0, *(len(r[0]) for r in runs)])[from_run] + from_place
        s = np.frombuffer(b"".join(x for r in runs for x in r[0]), np.uint8).reshape(-1, WIDTH)[flat]
        doc, at = (np.concatenate([from_planes(x) for x in part[c]])[flat] for c in ("docs", "places"))
        low, high = covered(s, lcp, doc)
        hit = np.nonzero(high >= low)[0]
        hit = hit[np.argsort(from_run[hit], kind="stable")]
        names = part["run"].to_list()
        for r, i, j in slices(from_run[hit]):
            mine = hit[i:j]
            _, me, *_, starts, sizes = spans_row(0, names[r], at[mine] - high[mine], at[mine] - low[mine] + LENGTH)
            out.append((me, starts, sizes))
    return pd.DataFrame(out, columns=["run", "starts", "sizes"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def cut_run(docs: pd.DataFrame, spans: pd.DataFrame, bits: int) -> pd.DataFrame:
    """A run's texts without their spans."""
    if not len(docs):
        return pd.DataFrame([], columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    run = Run(docs, bits)
    size = len(run.b)
    depth = np.zeros(size + 1, np.int32)
    for starts, sizes in zip(spans["starts"], spans["sizes"], strict=True):
        start = np.cumsum(from_planes(starts))
        np.add.at(depth, start, 1)
        np.add.at(depth, start + from_planes(sizes), -1)
    gone = np.cumsum(depth[:size], dtype=np.int32) > 0
    begins = gone & ~np.r_[False, gone[:-1]] if size else gone
    some = run.starts[run.starts < run.ends]
    begins[some] = gone[some]
    removed, runs = (np.r_[np.int32(0), np.cumsum(x, dtype=np.int32)] for x in (gone, begins))
    i, j = run.starts, run.ends
    kept, x, y = run.b[~gone].tobytes(), (i - removed[i]).tolist(), (j - removed[j]).tolist()
    return pd.DataFrame({"doc_id": run.ids, "n_bytes": j - i, "n_removed": removed[j] - removed[i], "n_spans": runs[j] - runs[i], "kept": [kept[a:z] for a, z in zip(x, y, strict=True)]})


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_from: int = HOT, run_bytes: int | None = None) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes).

    Null text counts as empty. Rows with a null id keep their text and take no part. Rows that repeat an
    id don't remove each other's bytes. An empty table gives no rows. What is removed is judged on the input.
    run_bytes: text that one task sorts at once; by default RUN_BYTES, growing with the square root of tables beyond 256 GB up to LARGEST_RUN.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    runs = max(32, -(-size // (run_bytes or max(RUN_BYTES, min(LARGEST_RUN, math.isqrt(size << 10))))))
    bits = min(64, max(36, size.bit_length() + 4))  # a hash meets another by chance once in some hundred
    src = rows.filter("doc_id IS NOT NULL").withColumn("run", F.pmod(F.xxhash64("doc_id", "t"), F.lit(runs)).cast("int"))
    cells = src.groupBy("run").applyInPandas(lambda d: hash_run(d, bits, runs), CELLS)
    flags = cells.groupBy("part").applyInPandas(lambda c: compare_hashes(c, hot_from), FLAGS)
    suffixes = src.groupBy("run").cogroup(flags.groupBy("run")).applyInPandas(lambda d, f: sort_run(d, f, bits, runs), SORTED)
    spans = suffixes.groupBy("part").applyInPandas(merge_part, SPANS)
    out = src.groupBy("run").cogroup(spans.groupBy("run")).applyInPandas(lambda d, s: cut_run(d, s, bits), RESULT)
    none = rows.filter("doc_id IS NULL").select("doc_id", F.octet_length("t").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.encode("t", "UTF-8"))
    return out.union(none)
