"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chunks, exact_dedup, fim, licenses, minhash, mixing, packing, pii, quality, suffixes, token_counts, vector_codes
from .common import table


#: Shares of the mixture's tokens; clean documents are all used and set the scale.
WEIGHTS = {"clean": 0.93, "low": 0.05, "toxic": 0.02}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.draw(mixing.mixing_rates(table(spark, sf_dir, "documents"), labels, WEIGHTS, "clean"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


OP2_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.t) AS text_sha256 FROM t JOIN g ON t.t = g.t
"""


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: a directory for each source, in it one for 1000 and in these one for 50 documents; the licence files of a directory are its documents divisible by 25."""
    docs = table(spark, sf_dir, "documents")
    of = lambda letter, n: F.concat(F.lit(letter), F.floor(F.col("doc_id") / n).cast("string"))
    place = F.concat_ws("/", "source", of("m", 1000), of("d", 50), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select("doc_id", "text", place.alias("path"))
    return licenses.scan_licenses(files, "path", "text", "doc_id", speaks=F.col("doc_id") % 25 == 0)


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.substring_dedup(table(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("text", 256))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the setting landloom.pii.key; where there is none, one is drawn for this session, so nobody can know it beforehand."""
    if not spark.conf.get("landloom.pii.key", ""):
        spark.conf.set("landloom.pii.key", secrets.token_hex(32))
    return pii.surrogates(table(spark, sf_dir, "documents"), key=spark.conf.get("landloom.pii.key"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), packing.default_tokenizer())
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return pieces.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), packing.default_tokenizer(), limit=512)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_sql(rounds: int = 6) -> str:
    """A key tells an entry and its distance: distance x 16 + entry, so the least key is the nearest entry, ties to the smaller."""
    key = "min(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + b.e)"
    nearest = "SELECT p.part, p.n, any_value(p.x) AS x, {key} AS key FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.part, p.n"
    steps = [
        """p AS MATERIALIZED (SELECT part::INT AS part, n, v[part * w + 1 : part * w + w] AS x, w FROM k, range(8) r(part))""",
        """b0 AS MATERIALIZED (SELECT part, n - 1 AS e, x AS c FROM p WHERE n <= 16)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(key=key, r=r)})")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT part, key % 16 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS m FROM a{r}, range(1, (SELECT max(w) FROM p) + 1) t(i) GROUP BY part, key % 16, i),
l{r} AS (SELECT part, e, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY part, e),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(l.c, b.c) AS c FROM b{r} b LEFT JOIN l{r} l ON b.part = l.part AND b.e = l.e)""")
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n, len(embedding) // 8 AS w, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
{", ".join(steps)},
d AS (SELECT string_agg(array_to_string(c, ','), ',' ORDER BY part, e) AS t FROM b{rounds}),
c AS (SELECT n, string_agg('0' || substr('0123456789abcdef', (key % 16)::INT + 1, 1), '' ORDER BY part) AS code, sum(key // 16)::BIGINT AS error FROM a{rounds} GROUP BY n)
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(t) FROM d) AS codebooks_sha256
FROM c JOIN k USING (n)
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM t),
v AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t
        WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
        ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM v
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_licenses": op4_licenses,
    "op5_chunk_dedup": op5_chunk_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_nearest": op7_nearest,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_token_counts": op11_token_counts,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op12_vector_codes": op12_sql(), "op13_fill_in_middle": OP13_SQL}
