"""The stages of corpus_pipeline against brute force, on rows with nulls, repeats and columns of clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import LOWER, fixture, near_brute

import corpus_pipeline as P
from landloom.llm import mixing, packing, quality


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(9)
    rows = [(i, t, lang, s, n) for i, t, lang, s, n, _, _ in fixture(11, 160)]
    junk = [(1000 + i, " ".join(rng.choice("ABCDEF") * 4 + "!!" for _ in range(60)), "en", "src1", 240) for i in range(40)]
    odd = [(None, "a text without an id", None, None, None), rows[20], rows[20], (2000, None, None, None, None)]
    docs = spark.createDataFrame(rows + junk + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(k % 9 == 0)) for k, (i, *_) in enumerate(rows)] + [(i, 0, 0) for i, *_ in junk] + [(None, 1, 0), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def clashing(df):
    return df.withColumn("t", F.lit("x")).withColumn("kept", F.lit(False)).withColumn("component_id", F.lit(7)).withColumn("score", F.lit(1.5)).withColumn("h", F.lit(None).cast("string"))


def key(r):
    return repr(tuple(r))


def test_quality_stage(spark, sf_dir):
    docs = clashing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = P.quality_stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    low = {r.doc_id for r in quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 0").collect()} - {None}
    want = sorted(key(r) for r in docs.collect() if r.doc_id not in low)
    assert sorted(key(r) for r in out.collect()) == want
    assert not any(1000 <= (r.doc_id or 0) < 1040 for r in out.collect())


def test_exact_stage(spark, sf_dir):
    docs = clashing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = P.exact_stage(spark, docs, sf_dir)
    best = {}
    for r in docs.collect():
        t = (r.text or "").translate(LOWER)
        rank = (r.doc_id is None, r.doc_id or 0)
        if t not in best or rank < best[t][0]:
            best[t] = (rank, r.doc_id)
    got = sorted(((r.text or "").translate(LOWER), r.doc_id is None, r.doc_id or 0) for r in out.collect())
    assert got == sorted((t, d is None, d or 0) for t, (_, d) in best.items()) and out.columns == docs.columns


def test_near_stage(spark, sf_dir):
    docs = clashing(P.exact_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir))
    rows = docs.collect()
    want = near_brute([(r.doc_id, r.text) for r in rows if r.doc_id is not None], 5, 80, 100)
    out = P.near_stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(d for d, (_, c) in want.items() if c == d)
    assert sum(r.doc_id is None for r in out.collect()) == 1


def test_mixing_stage(spark, sf_dir):
    docs = clashing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    gone = {r.doc_id for r in mixing.draw(mixing.mixing_rates(docs, labels, P.WEIGHTS, "clean")).filter("copies = 0").collect()} - {None}
    out = P.mixing_stage(spark, docs, sf_dir)
    assert sorted(key(r) for r in out.collect()) == sorted(key(r) for r in docs.collect() if r.doc_id not in gone)


def test_whole_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
    encode = packing.encoder(packing.default_tokenizer())
    want = sorted((r.doc_id is None, r.doc_id or 0, len(encode(r.text or "")) + 1) for r in docs.collect())
    n = {}
    for r in P.run(spark, sf_dir).collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + len(np.frombuffer(bytes(r.ids), "<u4"))
    assert sorted((d is None, d or 0, k) for d, k in n.items()) == want


def test_empty(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
