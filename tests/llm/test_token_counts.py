"""Counts of the transducer against the libraries of the tokenizer files."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from landloom.llm import packing
from landloom.llm import token_counts as tc

PATH = packing.default_tokenizer()
SCHEMA = "doc_id long, text string, n_bytes long, n_tokens long, t string, over_limit string"
ALPHABET = "ab 's\n\t'rexlL1 2!?.é漢\U0001f600  dtm'v́٣½ \x00"


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    return lambda texts: [len(e) for e in tok.encode_batch(texts, add_special_tokens=False)]


def counted(texts):
    parts = [t.encode() for t in texts]
    at = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    return tc.compiled(PATH)(np.frombuffer(b"".join(parts), np.uint8), at).tolist()


def odd_texts(seed, n=600):
    rng = random.Random(seed)
    out = ["", "'s", "it's", "''s", "'re'll'x", " 's  'd", "\n\n x", "a  b   ", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|><|endoftext|>", "x <|endoftext|", "|>", "'<|endoftext|>s", " <|endoftext|>", "'s's'rex 'll"]
    out += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    out += ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(30)) for _ in range(n // 4)]
    out += [base64.b64encode(rng.randbytes(rng.randint(1, 90))).decode() for _ in range(n // 4)]
    rng.shuffle(out)
    return out


def test_odd_texts(library):
    texts = odd_texts(1)
    assert counted(texts) == library(texts)
    assert counted([]) == [] and counted(["", ""]) == [0, 0]


def test_every_token_and_pairs(library):
    tokens = [b.decode() for b in packing.byte_ranks(PATH) if not any(x > 127 for x in b)]
    rng = random.Random(2)
    texts = rng.sample(tokens, 4000) + ["".join(rng.choices(tokens, k=3)) for _ in range(3000)]
    assert counted(texts) == library(texts)


def test_long_words(library):
    """Chunks that lie wholly inside one word, of one period and of none."""
    rng = random.Random(3)
    texts = ["a" * 100_000, "ab" * 40_000, "\n" * 5000 + " " * 70_000, "漢字" * 20_000, "=" * 50_000, "".join(rng.choice("abcde") for _ in range(60_000)), "".join(rng.choice("thein") for _ in range(60_000)), "tail's"]
    assert counted(texts) == library(texts)


@pytest.mark.parametrize(("piece", "states", "least", "run_up"), [(1 << 21, 1 << 17, 1, 1), (97, 1 << 17, 8, 3), (40, 150, 4, 2), (5000, 400, 16, 8)])
def test_small_slices_chunks_and_tables(library, monkeypatch, piece, states, least, run_up):
    """Borders of slices and chunks anywhere, guesses that fail, tables that fill up."""
    for name, value in (("SLICE", piece), ("STATES", states), ("LEAST", least), ("RUN_UP", run_up)):
        monkeypatch.setattr(tc, name, value)
    tc.compiled.cache_clear()
    texts = odd_texts(5, 60) + ["aaaa" * 60, "the then" * 40, "abcabcab" * 50]
    assert counted(texts) == library(texts)
    tc.compiled.cache_clear()


def test_operator(spark, library):
    texts = odd_texts(6, 200) + [None, "word " * 600, "x" * 1_000_000]
    rows = [(i % 300, t, 1, 1, "clash", "clash") for i, t in enumerate(texts)] + [(None, "no id", 0, 0, "", ""), (2**60 + 1, "a", 0, 0, "", "")]
    out = tc.token_counts(spark.createDataFrame(rows, SCHEMA), PATH)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = library([r[1] or "" for r in rows])
    want = sorted(((r[0], len((r[1] or "").encode()), k, k > 512) for r, k in zip(rows, n, strict=True)), key=repr)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert tc.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files(spark, name):
    """Files that are no byte-level BPE go to their library."""
    path = public_tokenizers.path(name)
    texts = ["", "Some words, more WORDS.", "  é漢 \U0001f600"]
    if name.endswith(".json"):
        want = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_tokens for r in tc.token_counts(df, path).orderBy("doc_id").collect()] == want
