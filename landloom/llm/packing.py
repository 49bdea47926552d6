"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

Each document is a run of token ids with a separator id at its end. Within a block of sequences the
pieces go out in descending length, each to the sequence of lowest cost (tokens + tokens^2 / length,
the linear and the attention part of a training step) among those that have room for it; what fits
nowhere whole is cut over the sequences of lowest cost that still have room. A block opens only as many
sequences as its tokens fill; the rest waits for the next block, and the last rest of a task goes into
sequences whose lengths are powers of two, so nothing is padded. There is no shuffle: tasks pack what
they read, and a sequence's id names the task, so that a task run again gives the same rows.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_text

#: Fixed value: how byte-level BPE files part a text into words.
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LONG_BLANKS = 20_000
SCHEMA = "doc_id string, start long, ids binary, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE file as bytes -> id, or None where the file is of another kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    if not plain or model.get("type", "BPE") != "BPE":
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {x["content"] for x in spec.get("added_tokens", [])}
    return {bytes(letter[c] for c in token): i for token, i in model["vocab"].items() if token not in added}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids of the tokenizer file, without special tokens added.

    For byte-level BPE files the merges run in tiktoken, over the same vocabulary, at four times the
    speed; texts that hold the string of an added token or a very long run of blanks (its pattern search fails
    on these), and files of other kinds, go to tokenizers.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    whole = lambda s: np.array(tok.encode(s, add_special_tokens=False).ids, "<u4")
    ranks = byte_ranks(path)
    if ranks is None:
        _encoders[path] = whole
        return whole
    import tiktoken

    ordinary = tiktoken.Encoding("own", pat_str=WORD, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    blanks = re.compile(rf"\s{{{LONG_BLANKS}}}")
    special = re.compile("|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values()) or r"(?!)")

    def encode(text: str) -> np.ndarray:
        return whole(text) if special.search(text) or len(text) >= LONG_BLANKS and blanks.search(text) else np.frombuffer(array("I", ordinary(text)), "<u4")

    _encoders[path] = encode
    return encode


def assign(items: list[tuple], room: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """items (key, start, ids) over sequences with that much room: placed (key, start, ids, sequence, offset) and what is left."""
    size = room.copy()
    room, cost, full = room.copy(), np.zeros(len(room)), float(room.max(initial=1))
    placed, left = [], []
    for key, start, ids in sorted(items, key=lambda x: -len(x[2])):
        while len(ids):
            fits = np.where(room >= len(ids), cost, np.inf)
            k = int(fits.argmin()) if len(fits) else -1
            if k < 0 or fits[k] == np.inf:
                fits = np.where(room > 0, cost, np.inf)
                k = int(fits.argmin()) if len(fits) else -1
                if k < 0 or fits[k] == np.inf:
                    left.append((key, start, ids))
                    break
            n = min(len(ids), int(room[k]))
            placed.append((key, start, ids[:n], k, int(size[k] - room[k])))
            room[k] -= n
            cost[k] += n + n * n / full
            ids, start = ids[n:], start + n
    return placed, left


def pack_block(items: list[tuple], length: int, last: bool) -> tuple[list[tuple], list[tuple], int]:
    """Placed pieces, what waits for the next block, and the number of sequences. last: the rest goes into powers of two."""
    n = sum(len(x[2]) for x in items)
    sizes = [length] * (n // length)
    placed, left = assign(items, np.array(sizes, np.int64))
    if last and left:
        rest = sum(len(x[2]) for x in left)
        more = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        tail, none = assign(left, np.array(more, np.int64))
        placed += [(key, start, ids, k + len(sizes), offset) for key, start, ids, k, offset in tail]
        sizes, left = sizes + more, none
    return placed, left, len(sizes)


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", block: int = 256) -> DataFrame:
    """One row a piece: doc_id, start (ids of its document before it), ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Each id of each document, its separator included, lies in exactly one piece; pieces fill a
    sequence from offset 0 without gaps. A null or empty text is its separator alone. Rows that
    repeat an id are packed each; a null id stays null. An empty table gives no rows. Equal lengths
    keep the order of the input. block: sequences weighed against each other at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, base, n = encoder(tokenizer), TaskContext.get().partitionId() << 40, 0
        end = np.array([separator], "<u4")
        waiting: list[tuple] = []
        held = 0

        def rows(last: bool) -> pd.DataFrame:
            nonlocal waiting, held, n
            placed, waiting, used = pack_block(waiting, length, last)
            held = sum(len(x[2]) for x in waiting)
            out = [(key[0], start, ids.tobytes(), key[1], base + n + k, offset) for key, start, ids, k, offset in placed]
            n += used
            return pd.DataFrame(out, columns=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        for part in batches:
            for d, t in zip(part["doc_id"].to_list(), part["t"].to_list(), strict=True):
                ids = np.concatenate([encode(t), end])
                waiting.append(((d, len(ids)), 0, ids))
                held += len(ids)
                if held >= block * length:
                    yield rows(False)
        if waiting:
            yield rows(True)

    src = docs.select(id_text(F.col(id_col)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return id_back(src.mapInPandas(run, SCHEMA), "doc_id")


def default_tokenizer() -> str:
    """The public byte-level BPE of 50,257 ids; every node has the file in the same place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
