"""Exact token counts by a finite-state transducer compiled from a byte-level BPE file.

A valid BPE encoding is a chain of tokens of which each two neighbours stand apart under the merges, and each
prefix of a word has exactly one. So the transducer's state is the set of tokens that may still be open at a byte: for each, the
last token of the chain before it, its node in the vocabulary's trie, and how many tokens that chain has more or less than the best one
to here. The next byte determines the next state and the change of the count, which annotates the transition; the counts of a text are
the sums of its transitions. Transitions are compiled when first met and kept in a table; a full table is begun anew,
so memory doesn't grow with the data.

Where words begin depends on the classes of at most four code points side by side, so it is found for all of a slice at once. A slice of
the bytes of many texts (or of a part of one) is cut into chunks of equal length that run side by side, a byte of each in a
step. Each chunk maps the state it is entered in to the state it ends in. A chunk with a word's begin shortly before it is entered in
a known state; for the others, inside very long words, the entry is guessed by a run-up, and the maps are composed by a prefix scan of
doubling distance. Entries that a map lacks are added by another run of their chunks, until the scan is whole. There is no shuffle.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import begins, utf8
from .packing import byte_ranks

SLICE = 1 << 21  # bytes that run at once
CHUNKS = 4096  # side by side
LEAST = 64  # bytes of a chunk
RUN_UP = 64  # bytes read before a chunk to guess its entry
STATES = 1 << 18  # of the table; a row has 256 entries of 4 bytes, so 256 MB a worker at most
BESIDE = 1 << 19  # pairs of tokens whose standing apart is remembered
FEW = 16  # tokens below a node up to which it is asked whether one of them may still come about
MARGIN = 32  # bytes around a slice that tell where its words begin
LETTER, NUMBER, SPACE = 1, 2, 3
KEEP = ~255
BEGIN = struct.pack("<iii", -1, 0, 0)  # a word's begin: no token before, the trie's root


class Full(Exception):
    """The table has no room for another state."""


class Transducer:
    """State and count after each byte of a word, for the merges of one file."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]], kinds_of=None):
        tokens = list(ranks)
        number = {t: i for i, t in enumerate(tokens)}
        self.pair, none = {}, len(merges)
        self.made, self.parts = [-1] * len(tokens), [(-1, -1)] * len(tokens)
        for rank, (a, b) in enumerate(merges):
            x, y, z = number[a], number[b], number[a + b]
            if self.pair.setdefault((x, y), rank) == rank and self.made[z] < 0:
                self.made[z], self.parts[z] = rank, (x, y)
        self.never = none
        # A token is found only if its own merges come about: nothing across its middle may merge before.
        own = [len(t) == 1 or self.made[i] >= 0 for i, t in enumerate(tokens)]
        for i in sorted(range(len(tokens)), key=lambda i: self.made[i]):
            if self.made[i] >= 0:
                x, y = self.parts[i]
                own[i] = own[x] and own[y] and self.apart(x, y, self.made[i])
        self.child, self.token = {}, [-1]
        for i, t in enumerate(tokens):
            if own[i]:
                node = 0
                for b in t:
                    key = node << 8 | b
                    if key not in self.child:
                        self.child[key] = len(self.token)
                        self.token.append(-1)
                    node = self.child[key]
                self.token[node] = i
        # The tokens that go on from a node, where they are few.
        self.below = [[] for _ in self.token]
        up = {v: k >> 8 for k, v in self.child.items()}
        for node, t in enumerate(self.token):
            at = up.get(node)
            while t >= 0 and at is not None:
                if len(self.below[at]) <= FEW:
                    self.below[at].append(t)
                at = up.get(at)
        self.near: dict[int, bool] = {}
        self.kinds_of = kinds_of
        self.kinds = np.full(0x110000, -1, np.int8)
        self.clear()

    def clear(self) -> None:
        self.states, self.ids = [], {}
        self.table = np.full(1 << 16, -1, np.int32)
        self.near.clear()
        self.state(BEGIN)  # has number 0

    def state(self, x: bytes) -> int:
        if x not in self.ids:
            if len(self.states) >= STATES:
                raise Full
            self.ids[x] = len(self.states)
            self.states.append(x)
            if len(self.states) << 8 > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
        return self.ids[x]

    def apart(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether no merge across the border of tokens a and b comes about (before that rank).

        Seen backwards: of the two merges next to the border the later is undone; a pair across the border that
        ranks before what was undone (of equal rank, on its left) would have been merged first.
        """
        limit = self.never if before is None else before
        while True:
            if self.pair.get((a, b), self.never) < limit:
                return False
            x, y = self.made[a], self.made[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, a = min(limit, x), self.parts[a][1]
            else:
                limit, b = min(limit, y + 1), self.parts[b][0]

    def beside(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        key = a << 20 | b
        if key not in self.near:
            if len(self.near) >= BESIDE:
                self.near.clear()
            self.near[key] = self.apart(a, b)
        return self.near[key]

    def transition(self, key: int) -> int:
        """Compiles the transition of state key >> 8 by byte key & 255; next state << 8 | change of the count + 128."""
        byte, open_, found = key & 255, [], None
        for before, node, more in struct.iter_unpack("<iii", self.states[key >> 8]):
            at = self.child.get(node << 8 | byte)
            if at is None:
                continue
            token = self.token[at]
            if token >= 0 and found is None and self.beside(before, token):
                found = token, more + 1
            below = self.below[at]
            if len(below) > FEW or any(self.beside(before, t) for t in below):
                open_.append((before, at, more))
        token, change = found
        new = self.state(b"".join(struct.pack("<iii", b, n, m - change) for b, n, m in open_) + struct.pack("<iii", token, 0, 0))
        self.table[key] = out = new << 8 | change + 128
        return out

    def steps(self, symbols: np.ndarray, masks: np.ndarray, entry: np.ndarray, path: np.ndarray | None = None) -> np.ndarray:
        """Runs chunks side by side: symbols and masks (steps, chunks), entry packed states; the last packed states. path gets all."""
        now = entry.copy()
        key = np.empty_like(now)
        for k in range(len(symbols)):
            np.bitwise_and(now, masks[k], out=key)
            np.bitwise_or(key, symbols[k], out=key)
            now = self.table.take(key)
            if now.min(initial=0) < 0:
                for x in np.unique(key[now < 0]).tolist():
                    self.transition(x)
                now = self.table.take(key)
            if path is not None:
                path[k] = now
        return now

    def run(self, data: np.ndarray, first: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """The count's change at each byte of a slice, and the state after it. first: which bytes begin a word; entry: the state before it."""
        n = len(data)
        chunks = max(1, min(CHUNKS, n // LEAST))
        size = -(-n // chunks)
        chunks = -(-n // size)
        padded = np.zeros(chunks * size, np.int32)
        padded[:n] = data
        mask = np.full(chunks * size, KEEP, np.int32)
        mask[:n][first] = 0
        symbols, masks = np.ascontiguousarray(padded.reshape(chunks, size).T), np.ascontiguousarray(mask.reshape(chunks, size).T)
        # The run-up of a chunk is the end of the chunk before it.
        back = min(RUN_UP, size)
        guess = np.zeros(chunks, np.int32)
        guess[1:] = self.steps(symbols[size - back :, :-1], masks[size - back :, :-1], guess[1:])
        guess[0] = entry << 8
        exact = np.r_[True, (masks[size - back :, :-1] == 0).any(0)] | (masks[0] == 0)
        path = np.empty((size, chunks), np.int32)
        last = self.steps(symbols, masks, guess, path) & KEEP
        guess &= KEEP
        if not exact.all():
            self.settle(symbols, masks, guess, last, path, exact)
        changes = ((path & 255) - 128).astype(np.int8).T.ravel()[:n]
        # The last chunk may be padded: its state is that of the last byte.
        return changes, int(path.T.ravel()[n - 1] >> 8)

    def settle(self, symbols: np.ndarray, masks: np.ndarray, guess: np.ndarray, last: np.ndarray, path: np.ndarray, exact: np.ndarray) -> None:
        """Mends path where the guess was wrong. Maps of chunks, entry -> last state, are composed from each exact chunk on."""
        maps = [{int(a): int(b)} for a, b in zip(guess, last, strict=True)]
        while True:
            lacking = [(j, e) for j in np.flatnonzero(~exact).tolist() for e in {*maps[j - 1].values()} - maps[j].keys()]
            if not lacking:
                break
            at = np.array([j for j, _ in lacking])
            ends = self.steps(symbols[:, at], masks[:, at], np.array([e for _, e in lacking], np.int32)) & KEEP
            for (j, e), x in zip(lacking, ends.tolist(), strict=True):
                maps[j][e] = x
        # Prefix scan: after the round of distance d, whole[j] maps the entry of chunk j - 2 d + 1 (or of the exact chunk after it).
        whole, since, d = list(maps), np.maximum.accumulate(np.where(exact, np.arange(len(maps)), 0)), 1
        for j in np.flatnonzero(exact).tolist():
            whole[j] = {int(guess[j]): maps[j][int(guess[j])]}
        while d < int((np.arange(len(maps)) - since).max()) + 1:
            whole = [{e: whole[j][x] for e, x in whole[j - d].items()} if j - d >= since[j] else whole[j] for j in range(len(maps))]
            d *= 2
        true = guess.copy()
        for j in np.flatnonzero(~exact).tolist():
            (true[j],) = whole[j - 1].values()
        wrong = np.flatnonzero(true != guess)
        if len(wrong):
            mended = np.empty((len(symbols), len(wrong)), np.int32)
            self.steps(symbols[:, wrong], masks[:, wrong], true[wrong], mended)
            path[:, wrong] = mended

    def classes(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point; those not met yet are asked of the library, so that its version of Unicode counts."""
        out = self.kinds[points]
        if out.min(initial=0) < 0:
            new = np.unique(points[out < 0])
            self.kinds[new] = self.kinds_of(new)
            out = self.kinds[points]
        return out

    def words(self, text: bytes, ends: np.ndarray) -> np.ndarray:
        """Which bytes begin a word; ends: the bytes at which a text (or what stands beside a special token) begins."""
        points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), "<u4")
        n = len(points)
        place = np.flatnonzero(begins(np.frombuffer(text, np.uint8)))
        kind = self.classes(points)
        new = np.zeros(n + 3, bool)
        new[np.searchsorted(place, ends)] = True
        new[n:] = True
        space = np.r_[kind == SPACE, True, True, True]
        first = new[:n].copy()
        if n > 1:
            was, now = space[: n - 1], space[1:n]
            blank = points[: n - 1] == 32
            stands = ~new[2 : n + 1] & ~space[2 : n + 1]  # more of the text follows, and it is no space
            begin = np.where(now, ~was | stands, np.where(was, ~blank, kind[1:] != kind[:-1]))
            first[1:] |= begin
        at = np.flatnonzero((points == 39) & first)
        if len(at):
            follow = np.r_[points, 0, 0, 0]
            one, two = follow[at + 1], follow[at + 2]
            inside = ~new[at + 1]
            short = inside & np.isin(one, [ord(c) for c in "stmd"])
            long_ = inside & ~new[at + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            first = np.r_[first, False, False, False]
            first[at[short] + 1] = False
            first[at[short] + 2] = True
            first[at[long_] + 1] = first[at[long_] + 2] = False
            first[at[long_] + 3] = True
            first = first[:n]
        out = np.zeros(len(text), bool)
        out[place[first]] = True
        return out

    def counts(self, data: np.ndarray, at: np.ndarray, special: re.Pattern | None = None) -> np.ndarray:
        """The number of tokens of each text; text i has the bytes at[i] to at[i + 1]."""
        ends, skipped = [at[:-1]], []
        if special and special.search(data):
            for i in range(len(at) - 1):
                skipped += [(int(at[i]) + m.start(), int(at[i]) + m.end()) for m in special.finditer(data[at[i] : at[i + 1]])]
            ends.append(np.array(skipped, np.int64).ravel())
        ends = np.unique(np.concatenate(ends))
        sums, total, entry, lo = np.zeros(len(at), np.int64), 0, BEGIN, 0
        size, fresh = SLICE, False
        while lo < len(data):
            hi = self.border(data, lo + size)
            a, b = self.border(data, max(0, lo - MARGIN)), self.border(data, min(len(data), hi + MARGIN))
            near = ends[np.searchsorted(ends, a) : np.searchsorted(ends, b)] - a
            first = self.words(data[a:b].tobytes(), near)[lo - a : hi - a]
            try:
                changes, state = self.run(data[lo:hi], first, self.state(entry))
            except Full:
                if fresh:  # not even an empty table takes this slice
                    size = max(MARGIN, min(size, STATES) // 2)
                self.clear()
                fresh = True
                continue
            fresh = False
            for s, e in skipped:
                if s < hi and e > lo:
                    changes[max(0, s - lo) : e - lo] = 0
                    if s >= lo:
                        changes[s - lo] = 1
            sum_ = np.r_[0, np.cumsum(changes, dtype=np.int64)] + total
            i, j = np.searchsorted(at, lo), np.searchsorted(at, hi)
            sums[i:j] = sum_[at[i:j] - lo]
            total, lo, entry = int(sum_[-1]), hi, self.states[state]
        sums[np.searchsorted(at, len(data)) :] = total
        return np.diff(sums)

    @staticmethod
    def border(data: np.ndarray, at: int) -> int:
        """The first code point's begin at or after a byte."""
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(data))


@lru_cache(maxsize=4)
def compiled(path: str):
    """(bytes, offsets) -> counts for a tokenizer file: a transducer for byte-level BPE, else its library."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda data, at: np.array([len(pieces.encode(data[a:b].tobytes().decode())) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks, model, added = byte_ranks(path), spec["model"], spec.get("added_tokens", [])
    odd = any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")) or any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if ranks is None or odd or sum(len(t) == 1 for t in ranks) < 256 or spec.get("post_processor"):
        return lambda data, at: np.array([len(tok.encode(data[a:b].tobytes().decode(), add_special_tokens=False)) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
    letters = {v: k for k, v in model["vocab"].items()}
    back = {letters[i]: t for t, i in ranks.items()}
    merges = [tuple(back[p] for p in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]

    def kinds_of(points: np.ndarray) -> list[int]:
        """A code point joins a letter, a number or a mark before it if it is one of its kind; spaces join none."""
        joins = lambda before, c: len(tok.pre_tokenizer.pre_tokenize_str(before + c)) == 1
        return [next((k for k, before in ((LETTER, "a"), (NUMBER, "1"), (0, "!")) if joins(before, chr(c))), SPACE) for c in points.tolist()]

    special = re.compile(b"|".join(re.escape(x["content"].encode()) for x in added)) if added else None
    transducer = Transducer(ranks, merges, kinds_of)
    return lambda data, at: transducer.counts(data, at, special)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    n_tokens is what the library of the tokenizer file counts, without special tokens added; special strings inside
    a text count as their token. A null text is empty and has no tokens. Rows that repeat an id are counted each; a null
    id stays null. An empty table gives no rows; other columns of docs are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data, at = utf8(part.column("t"))
            n = compiled(tokenizer)(data, at)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
