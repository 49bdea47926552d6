"""Fill-in-middle against a version on Python strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, output string, h0 string"
TEXTS = [None, "", "a", "é", "\U0001f600", "holds <S> inside", "<P", "<<P", "ends with <", "><", "\x00nul\n", "ab́c " * 700, "\U0001f600é漢a" * 5000, "x" * 3_000_000]


def brute(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted(x % (n + 1) for x in h[:2])
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_against_strings(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(TEXTS[:-1]), None, "clash", None, "clash") for i in range(400)]
    rows += [(7, t, None, None, None, None) for t in TEXTS] + [(None, "null id", None, None, None, None), (2**60 + 1, "large id", None, None, None, None), (-3, "abc", None, None, None, None)]
    df = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = df.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((r[0], *brute(r[0], r[1]), r[1] or "") for r in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("step", [1, 3, 16, 1024])
def test_checkpoints(step):
    text = "aé漢\U0001f600" * 97 + "end"
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.Checkpoints(data, step)
    assert index.n == len(text)
    assert [index.byte(i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]
