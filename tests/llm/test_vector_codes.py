"""Filtered rounds against plain ones in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from landloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string, `of` int, points string"


def brute(rows, parts=8, entries=16, rounds=6):
    """rows (vec_id, vector, label) of one length -> {(vec_id, code, error, label_error, sha)} as a sorted list."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cuts = vc.spans(len(kept[0][1]), parts)
    books = [[v[c] for _, v, _ in kept[:entries]] for c in cuts]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p, c in enumerate(cuts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v[c], books[p])[1], []).append(v[c])
            books[p] = [[sum(z) // len(groups[e]) for z in zip(*groups[e], strict=True)] if e in groups else y for e, y in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        got = [near(v[c], books[p]) for p, c in enumerate(cuts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got)))
    return sorted(((*r, sum(o[3] for o in out if o[1] == r[1]), sha) for r in out), key=repr)


def vectors(seed, n, dim=16):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        # Coarse steps give many ties between entries.
        v = [float(np.float32(round(x + rng.gauss(0, 0.3), 1) if i % 3 else x + rng.gauss(0, 0.01))) for x in c]
        out.append((i * 7 % 1009, v, rng.choice([None, 1, 1, 1, 2])))
    return out


@pytest.mark.parametrize("n", [1, 9, 700])
def test_against_plain_rounds(spark, n):
    rows = vectors(n, n)
    rows += [(rows[0][0], rows[0][1], 2)] * 40 if n > 10 else []
    rows += [(3, None, 1), (4, [None] * 16, 1), (5, [float("nan")] * 16, 1), (6, [float("inf")] + [0.0] * 15, None), (2000, [0.0] * 16, None), (None, [0.5] * 16, None)]
    df = spark.createDataFrame([(*r, "clash", "clash", 1, "clash") for r in rows], SCHEMA).repartition(5)
    out = vc.vector_codes(df)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)


def test_lengths_and_extremes(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.5], 1), (3, [3e38, -3e38] * 8, 2), (4, [0.0] * 16, 2), (5, [], 3)]
    got = {r.vec_id: r for r in vc.vector_codes(spark.createDataFrame([(*r, "", "", 0, "") for r in rows], SCHEMA)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and all(r.error == 0 for r in got.values())
    assert got[1].code == "00" * 8 and got[2].codebooks_sha256 == got[1].codebooks_sha256 != got[3].codebooks_sha256
    assert vc.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("d", [1, 2, 8])
def test_tree_assigns_as_brute_force(d):
    rng = np.random.default_rng(d)
    for n in (1, 16, 17, 500, 4096):
        x = rng.integers(-20, 20, (n, d))
        book = np.concatenate([x[:12], rng.integers(-20, 20, (4, d))])[:16]
        tree = vc.Tree.planted(x)
        entry, total, count = tree.assigned(book, x)
        want = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert (entry == want).all() and (count == np.bincount(want, minlength=len(book))).all()
        assert all((total[e] == x[want == e].sum(0)).all() for e in range(len(book)))
    # Far clusters go to their entries by whole subtrees, with few points weighed one by one.
    x = np.concatenate([rng.integers(-5, 5, (300, d)) + 1000 * k for k in range(4)])
    tree, seen = vc.Tree.planted(x), []
    entry, _, _ = tree.assigned(np.stack([np.full(d, 1000 * k) for k in range(4)]), _Counted(x, seen))
    assert (entry == np.repeat(np.arange(4), 300)).all() and sum(seen) <= 4 * vc.LEAF


class _Counted:
    """Points that tell how many of them were looked at."""

    def __init__(self, x, seen):
        self.x, self.seen = x, seen

    def __getitem__(self, at):
        self.seen.append(len(at))
        return self.x[at]
