"""Odd ids, columns and texts, and operators against independent brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from landloom.llm import ann, chunks, exact_dedup, licenses, minhash, mixing, packing, pii, quality, suffixes

BIG = 2**53
TEXT = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [(BIG + 1, TEXT), (None, "no id at all " + TEXT), (BIG + 3, TEXT + " more words follow here"), (BIG + 3, "another text of the same id"), (BIG + 5, None), (BIG + 5, None), (7, "")]
CLASH = "doc_id long, text string, t string, s string, h string, kept string, n long, `a.b` string, m map<string,int>, row string"


@pytest.fixture(scope="module")
def odd(spark):
    """Ids beyond 2^53 beside a null, repeated ids and rows, and columns named as the operators' own."""
    return spark.createDataFrame([(i, x, "t", "s", "h", "kept", 1, "dot", {"k": 1}, "row") for i, x in ROWS], CLASH)


IDS = sorted((str(i) for i, _ in ROWS))


def ids_of(df, name="doc_id"):
    return sorted(str(r[name]) for r in df.select(name).collect())


def test_ids_survive(spark, odd):
    labels = spark.createDataFrame([(BIG + 1, 1), (7, 0), (BIG + 5, 1)], "doc_id long, quality int")
    assert ids_of(minhash.near_duplicates(odd)) == IDS
    assert ids_of(licenses.scan_licenses(odd, "t", "text", "doc_id", F.lit(True))) == IDS
    assert ids_of(chunks.substring_dedup(odd)) == IDS
    assert ids_of(suffixes.suffix_dedup(odd)) == IDS
    assert ids_of(quality.quality_scores(odd, labels)) == IDS
    assert ids_of(exact_dedup.exact_groups(odd)) == IDS
    assert ids_of(pii.surrogates(odd, "k")) == IDS
    assert ids_of(mixing.mixing_rates(odd, labels.select("doc_id", F.lit("clean").alias("domain")), {"clean": 1.0, "low": 0.5}, "clean")) == IDS
    pieces = packing.pack(odd, packing.default_tokenizer())
    assert set(ids_of(pieces)) == set(IDS)


def test_exact_keeps_any_columns(odd):
    out = exact_dedup.exact_dedup(odd)
    assert out.schema == odd.schema
    got = sorted((str(r.doc_id), r.text or "") for r in out.collect())
    assert got == sorted({(str(BIG + 1), TEXT), ("None", ROWS[1][1]), (str(BIG + 3), ROWS[2][1]), (str(BIG + 3), ROWS[3][1]), ("7", "")})


def test_exact_exchanges_a_text_once(spark):
    """Copies that differ in case give back the text of the row that stays, and texts cross the exchange once, not beside themselves."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghijklmnopqrstABCDé ") for _ in range(3000)) for _ in range(300)] + ["Z", "Ab" + "x" * 300 + "C", "é" * 254 + "Q"]
    rows = [(k, t) for k, t in enumerate(base)] + [(1000 + k, t.upper() if t.isascii() else t.translate({65: 97})) for k, t in enumerate(base)] + [(2000, "aB"), (2000, "Ab"), (3000, None), (3001, "")]
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = written()
    got = {r.doc_id: r.text for r in exact_dedup.exact_dedup(df).collect()}
    assert got == dict(enumerate(base)) | {2000: "Ab", 3000: None}
    assert written() - before < 1.4 * sum(len((t or '').encode()) for _, t in rows)


def test_repeated_ids_link_by_each_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "alone here now")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_suffixes_with_odd_ids(spark):
    passage = "the same passage of well over fifty bytes stands in all of these documents, " * 3
    rows = [(BIG + 3, "x " + passage), (BIG + 1, passage + "y"), (None, passage), (5, passage[:49]), (BIG + 3, passage), (9, None)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), run_bytes=64).collect())
    n = len(passage)
    assert got == sorted([(str(BIG + 3), n + 2, n + 1), (str(BIG + 1), n + 1, 0), ("None", n, 0), ("5", 49, 0), (str(BIG + 3), n, n), ("9", 0, 0)])


def test_suffixes_many_copies_of_long_runs(spark):
    """Periodic texts, one passage in every document between differing neighbours, and copies: all hot."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef ") for _ in range(90))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(40)) + passage + str(i) * 30) for i in range(60)] + [(100 + i, "ab" * 400) for i in range(5)] + [(200 + i, passage) for i in range(20)]
    want = {}
    first = {}
    for d, t in rows:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(d, first.get(t[i : i + 50], d))
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            gone[i : i + 50] |= first[t[i : i + 50]] < d
        want[d] = "".join(c for c, g in zip(t, gone) if not g)
    for hot in (3, 10_000):
        got = {r.doc_id: bytes(r.kept).decode() for r in suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot_from=hot, run_bytes=500).collect()}
        assert got == want


def test_packing_long_blanks(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(1, " " * 3_000_000), (2, "\n" * 1_000_000 + "a"), (3, "word " * 2000)]
    total = {i: 0 for i, _ in rows}
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), packing.default_tokenizer()).collect():
        total[r.doc_id] += len(r.ids) // 4
    assert total == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}


def test_packing_balances_costs(spark):
    """Within a block a piece goes to the cheapest sequence with room: no sequence is much dearer than another."""
    rng = random.Random(1)
    items = [((i, 0), 0, np.arange(rng.randint(5, 60))) for i in range(400)]
    placed, left, n = packing.pack_block(items, 128, last=False)
    fill, cost = np.zeros(n), np.zeros(n)
    for _, _, ids, k, offset in placed:
        assert offset == fill[k]
        fill[k] += len(ids)
        cost[k] += len(ids) + len(ids) ** 2 / 128
    assert (fill <= 128).all() and cost.max() / cost.min() < 1.6
    assert sum(len(x[2]) for x in left) + fill.sum() == sum(len(x[2]) for x in items)


def test_nearest_scales_lengths_and_repeats(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8))
    for scale in (1e-160, 1e-7, 1.0, 1e120):
        rows = [(i, (v * scale).tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {}
        for r in ann.nearest(df, 20, 3).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        want = {i: [j for j in np.lexsort((np.arange(200), -(x @ x[i]))) if j != i][:3] for i in range(0, 200, 20)}
        assert np.mean([len(set(got[i]) & set(want[i])) / 3 for i in want]) >= 0.9, scale
    mixed = [(20, [1.0, 0.0]), (21, [0.5, 0.5]), (22, [0.9, 0.1]), (40, [1.0, 0.0, 0.0]), (41, [0.2, 0.0, 0.0]), (22, [0.1, 0.9]), (None, [1.0, 1.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(mixed, "vec_id long, embedding array<double>"), 20, 5).collect())
    assert got == [(20, 1, 22, 0.9), (20, 2, 21, 0.5), (40, 1, 41, 0.2)]


def test_visits_are_the_best_buckets():
    """The buckets above the cut are found whole and in order, as by looking at all combinations of cells."""
    tables = ann.Tables(6, 3, 1.0)
    rng = np.random.default_rng(0)
    log_p = tables.log_success(0, ann.unit(rng.standard_normal((4, 6))), np.full(4, 0.6))
    for p, cut in zip(log_p, tables.cut(log_p, 0)):
        every = sorted(((p[0, a] + p[1, b] + p[2, c], a | b << 4 | c << 8) for a in range(12) for b in range(12) for c in range(12)), key=lambda z: -z[0])
        want = [k for s, k in every if s >= cut]
        got = tables.visited(p, cut).tolist()
        assert set(got) == set(want) and got[0] == want[0]


def brute_licence(texts, threshold=0.75):
    """Every line, whole file and window of a template's length, weighed one by one."""
    names, words = [n for n, _ in licenses.TEMPLATES], [licenses.terms(t) for _, t in licenses.TEMPLATES]
    vocabulary = set(licenses.VOCABULARY)
    slot = lambda w: w if w in vocabulary else zlib.crc32(w.encode()) % licenses.SLOTS
    df = {}
    for t in texts:
        for w in {slot(w) for w in licenses.terms(t)}:
            df[w] = df.get(w, 0) + 1
    idf = lambda w: math.log(1 + len(texts) / (1 + df.get(w, 0)))

    def vector(own):
        v = {}
        for w in own:
            v[slot(w)] = v.get(slot(w), 0.0) + idf(slot(w))
        return v, math.sqrt(sum(x * x for x in v.values())) or 1.0

    known = [vector(w) for w in words]
    out = []
    for t in texts:
        best = None
        lines = [(i + 1, licenses.terms(x)) for i, x in enumerate(t.split("\n"))]
        units = [(i, w, None) for i, w in lines if w] + [(next((i for i, w in lines if w), 1), licenses.terms(t), None)]
        at, flat = 1, []
        for piece in re.split(r"(\n(?:[^\S\n]*\n)+)", t):
            if re.fullmatch(r"\n(?:[^\S\n]*\n)+", piece):
                at += piece.count("\n")
                continue
            para = []
            for x in piece.split("\n"):
                para += [(at, w) for w in licenses.terms(x)]
                at += 1
            at -= 1
            flat.append(para)
        for para in flat:
            for n in {len(w) for w in words}:
                for i in range(len(para) - n + 1):
                    units.append((para[i][0], [w for _, w in para[i : i + n]], n))
        for line, own, n in units:
            v, norm = vector(own)
            for k, (tv, tn) in enumerate(known):
                if n is not None and n != len(words[k]):
                    continue
                cos = round(sum(x * tv.get(w, 0.0) for w, x in v.items()) / norm / tn, 12)
                if n is not None and n < licenses.ORDERED:
                    cos = float(own == words[k])
                if cos >= threshold and (best is None or (-cos, line, k) < best):
                    best = (-cos, line, k)
        out.append((names[best[2]], round(-best[0], 6), best[1]) if best else (None, None, None))
    return out


def test_licences_against_brute_force(spark):
    rng = random.Random(4)
    words = "river stone software use the of to any copy granted license version public without terms notice road".split()
    texts = []
    for i in range(120):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            name, t = rng.choice(licenses.TEMPLATES)
            own = t.split()
            if rng.random() < 0.4:
                own[rng.randrange(len(own))] = "given"
            if rng.random() < 0.5:
                own.insert(rng.randrange(len(own)), "\n# ")
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", "# ", "Copyright 2024 Acme Corp. "]) + " ".join(own))
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), "   ")
        texts.append("\n".join(lines))
    texts += ["", "reserved rights all", "Copyright 2024 Acme Corp. All rights reserved.", "The MIT License (MIT)", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "x " * 3000 + "All rights reserved.", "All rights reserved."] + [texts[0]] * 2
    want = brute_licence(texts)
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.score, r.line) for r in licenses.scan_licenses(df, "path", "text", "doc_id", F.lit(False)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(x[0] is not None for x in want) > 30


def test_quality_against_independent_discriminant(spark):
    """Scores equal log densities with shrunk covariances, computed by inverses and determinants."""
    rng = random.Random(6)
    text = lambda junk: " ".join((rng.choice("abcdefg") * rng.randint(1, 9)).upper() + "!" * rng.randint(0, 3) if junk else rng.choice("abcdefg") * rng.randint(2, 6) for _ in range(rng.randint(10, 60)))
    rows = [(i, text(i % 3 == 0), int(i % 3 != 0)) for i in range(200)] + [(500, "", 1), (501, None, 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    x = {i: quality.statistics(t) for i, t, _ in rows}
    train = {y: np.array([x[i] for i, _, z in rows if z == y and zlib.crc32(str(i).encode()) % 4 != 2]) for y in (0, 1)}
    n = {y: len(train[y]) for y in train}
    cov = {y: np.cov(train[y].T, bias=True) for y in train}
    pooled = (cov[0] * n[0] + cov[1] * n[1]) / (n[0] + n[1])
    shrunk = {y: 0.99 * (0.7 * cov[y] + 0.3 * pooled) + 0.01 * np.diag(np.maximum(np.diag(pooled), 1e-4)) for y in cov}
    for i, v in x.items():
        log = {}
        for y in (0, 1):
            d = v - train[y].mean(0)
            log[y] = -0.5 * (d @ np.linalg.solve(shrunk[y], d) + np.linalg.slogdet(shrunk[y])[1]) + math.log(n[y])
        assert abs(got[i] - 1 / (1 + math.exp(min(700, -0.25 * (log[1] - log[0]))))) < 1e-8


def surrogate_map(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.surrogates(df, key).orderBy("doc_id").collect()]


def test_pii_short_shapes_stay_distinct(spark):
    values = [f"{c}@b.co" for c in "abcdefghijklmnopqrstuvwxyz"]
    out = surrogate_map(spark, values)
    assert len(set(out)) == 26 and not set(out) & set(values) and all(re.fullmatch(pii.PATTERNS["email"], x) for x in out)


def test_pii_coreference(spark):
    out = surrogate_map(
        spark, ["Call +1 (743) 555-3824 or 743-555-3824.", "Anna Keller came. ANNA KELLER left, then Keller slept and Anna woke; Kellerman stayed.", "Dr. Anna Keller and Mrs. Keller.", "Mr. Wei Zhang met Priya Sharma and Mohammed Ali.", "My name is Kwame Nkrumah.", "Ring +44 20 79460958 now +442079460958"]
    )
    a, b = re.findall(r"\d{3}", out[0].replace("+1", "", 1))[:3], re.findall(r"\d{3}", out[0])[-3:]
    digits = re.sub(r"\D", "", out[0])
    assert digits[0] == "1" and digits[1:11] == digits[11:21] and digits[1:11] != "7435553824", (a, b)
    words = re.findall(r"\w+", out[1])
    given, last = words[0], words[1]
    assert words == [given, last, "came", given.upper(), last.upper(), "left", "then", last, "slept", "and", given, "woke", "Kellerman", "stayed"]
    assert given in pii.NAMES["latin_f"] and last != "Keller"
    assert out[2] == f"Dr. {given} {last} and Mrs. {last}."
    for name in ("Wei", "Zhang", "Sharma", "Ali", "Kwame", "Nkrumah"):
        assert not re.search(rf"\b{name}\b", out[3].replace("Wei ", "", 0) if name != "Wei" else "") and not re.search(rf"\b{name}\b", out[4])
    assert out[3].split()[1] in pii.NAMES["latin_m"] and "+44" in out[5]


def test_pii_formats(spark):
    iban = surrogate_map(spark, ["GB82 WEST 1234 5698 7654 32"])[0]
    plain = iban.replace(" ", "")
    assert iban != "GB82 WEST 1234 5698 7654 32" and plain[:2] == "GB"
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    with pytest.raises(ValueError):
        pii.surrogates(spark.createDataFrame([], "doc_id long, text string"), "")


def test_pii_hint_loses_nothing(spark):
    """Texts with one generated entity of each pattern: the short pattern never hides what the long one finds."""
    rng = random.Random(2)
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    make = [
        lambda: "AKIA" + "".join(rng.choice(letters + "0123456789") for _ in range(16)), lambda: "gh" + rng.choice("pousr") + "_" + "".join(rng.choice(letters.lower() + letters) for _ in range(36)),
        lambda: "sk-" + "".join(rng.choice(letters) for _ in range(24)), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        lambda: rng.choice(letters) + rng.choice(letters) + digit(2) + "".join(" " * rng.randint(0, 1) + "".join(rng.choice(letters) for _ in range(4)) for _ in range(4)),
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", lambda: "".join(rng.choice(" -") * rng.randint(0, 1) + rng.choice("0123456789") for _ in range(16)).strip(" -"),
        lambda: f"({digit(2)}) {digit(3)}-{digit(4)}", lambda: "+" + digit(9), lambda: rng.choice("abc") + "@" + rng.choice("xyz") + ".io", lambda: "Mrs. Xq", lambda: "name: Ab Cd",
    ]
    make += [lambda k=k: rng.choice(pii.NAMES[k]) + {"l": " Ng", "c": " Ли", "d": " राव"}[k[0]] for k in pii.NAMES]
    rows = [(i, rng.choice(["", "x ", "(", "é"]) + make[i % len(make)]() + rng.choice(["", " y", ")", "."])) for i in range(len(make) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.filter(pii.detected(F.col("text")) != pii.detected(F.col("text"), hint=False)).count() == 0


def test_mixing_posteriors(spark):
    """Memberships against naive Bayes counted by hand, for rows whose words the model saw."""
    rows = [(i, ["red stone", "red red river", "casino bonus", "insult slur", "river stone"][i % 5] + f" w{i % 7}") for i in range(100)]
    labels = [(i, ["clean", "clean", "low", "toxic", "clean"][i % 5]) for i in range(100)]
    got = mixing.mixing_rates(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string"), {"clean": 0.8, "low": 0.1, "toxic": 0.1}, "clean").toPandas()
    p = got[["p_clean", "p_low", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()
    kind = dict(labels)
    assert all(["clean", "low", "toxic"][row.argmax()] == kind[i] for i, row in zip(got.doc_id, p))
    same = {}
    for i, row in zip(got.doc_id, p):
        same.setdefault(dict(rows)[i], set()).add(tuple(np.round(row, 12)))
    assert all(len(v) == 1 for v in same.values())


def test_pipeline_without(spark, odd):
    dropped = spark.createDataFrame([(BIG + 3,)], "doc_id long")
    assert ids_of(corpus_pipeline.without(odd, dropped)) == sorted(i for i in IDS if i != str(BIG + 3))
