"""Queries on names, areas, identifiers, registers and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import text as T
from landloom.functions.num import coerce_number, exact_sum, ratio, rnd
from landloom.operators import attributes as A
from landloom.plans.registry import query


def s_rnd(e: str, n: int) -> str:
    return f"(floor(({e}) * {10**n}.0 + 0.5) / {10**n}.0)"


def s_latin(e: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LATIN.items())
    c = f"substring({e}, i, 1)"
    return f"upper(array_to_string(list_transform(range(1, length({e}) + 1), lambda i: CASE {c} {cases} ELSE CASE WHEN regexp_matches({c}, '^[\\p{{L}}\\p{{N}}\\s]$') THEN {c} ELSE '' END END), ''))"


def s_code(t: str) -> str:
    """The phonetic code of transliterated text t."""
    b = f"regexp_replace({t}, '\\s', '', 'g')"
    digits = f"regexp_replace(translate(substring({b}, 2), 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), '[^1-6]', '', 'g')"
    single = f"list_reduce(list_prepend('', list_transform(range(1, length({digits}) + 1), lambda i: substring({digits}, i, 1))), lambda a, d: CASE WHEN right(a, 1) = d THEN a ELSE concat(a, d) END)"
    return f"CASE WHEN length({b}) = 0 THEN 'Z000' ELSE rpad(left(concat(left({b}, 1), {single}), 4), 4, '0') END"


def s_scored(source: str, pairs: dict[str, tuple[str, str]], keep: str) -> str:
    """A chain of selects that adds for each name p the columns p_t, p_d, p_s, p_ca, p_cb, p_cs and p (score) of a pair of columns."""
    one = ", ".join(f"{s_latin(a)} AS {p}_t, {s_latin(b)} AS {p}_u" for p, (a, b) in pairs.items())
    two = ", ".join(
        f"levenshtein(lower(trim({p}_t)), regexp_replace(lower(trim({b})), '[^\\x00-\\x7F]', '~', 'g')) AS {p}_d, greatest(length({p}_t), length({b}), 1) AS {p}_n, {s_code(f'{p}_t')} AS {p}_ca, {s_code(f'{p}_u')} AS {p}_cb" for p, (_, b) in pairs.items()
    )
    three = ", ".join(f"greatest(0.0, 1.0 - {p}_d / {p}_n) AS {p}_s, CASE WHEN {p}_ca = {p}_cb THEN 1.0 WHEN left({p}_ca, 1) = left({p}_cb, 1) THEN 0.8 ELSE 0.2 END AS {p}_cs" for p in pairs)
    four = ", ".join(s_rnd(f"CAST({p}_s AS DOUBLE) * 0.5 + CAST({p}_cs AS DOUBLE) * 0.5", 4) + f" AS {p}" for p in pairs)
    return f"(SELECT {keep}, *, {four} FROM (SELECT *, {three} FROM (SELECT *, {two} FROM (SELECT *, {one} FROM {source}))))".replace(f"SELECT {keep}, *,", "SELECT *,")


NAMES = "v_local l CROSS JOIN v_english e"


@query(f"SELECT k, local_name, {s_latin('local_name')} AS latin FROM v_local UNION ALL SELECT CAST(c_custkey AS INTEGER), c_name, {s_latin('c_name')} FROM customer", "v_local", "customer")
def transliterate(spark: SparkSession, local: DataFrame, customer: DataFrame) -> DataFrame:
    both = local.union(customer.select(F.col("c_custkey").cast("int"), "c_name"))
    return both.select("k", "local_name", T.transliterate(F.col("local_name")).alias("latin"))


@query(f"SELECT name, {s_code('t')} AS code FROM (SELECT name, {s_latin('name')} AS t FROM (SELECT local_name AS name FROM v_local UNION ALL SELECT english_name FROM v_english UNION ALL SELECT p_name FROM part UNION ALL SELECT ' -- '))", "v_local", "v_english", "part")
def soundex_custom(spark: SparkSession, local: DataFrame, english: DataFrame, part: DataFrame) -> DataFrame:
    names = local.select("local_name").union(english.select("english_name")).union(part.select("p_name")).union(spark.createDataFrame([(" -- ",)], "x string")).toDF("name")
    return names.select("name", T.phonetic_code(F.col("name")).alias("code"))


@query(f"SELECT a.p_partkey AS idx, levenshtein(lower(trim(a.p_name)), lower(trim(b.p_name))) AS distance, {s_rnd('greatest(0.0, 1.0 - levenshtein(lower(trim(a.p_name)), lower(trim(b.p_name))) / greatest(length(a.p_name), length(b.p_name), 1))', 4)} AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1", "part")
def levenshtein_similarity(spark: SparkSession, part: DataFrame) -> DataFrame:
    a, b = part.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("a")), part.select((F.col("p_partkey") - 1).alias("idx"), F.col("p_name").alias("b"))
    d = F.levenshtein(F.lower(F.trim("a")), F.lower(F.trim("b")))
    return a.join(b, "idx").select("idx", d.cast("long").alias("distance"), rnd(F.greatest(F.lit(0.0), 1.0 - d / F.greatest(F.length("a"), F.length("b"), F.lit(1))), 4).alias("similarity"))


@query(
    f"SELECT idx, local_name, english_name, p_t AS transliterated, CAST(p_d AS BIGINT) AS distance, {s_rnd('p_s', 4)} AS similarity, p_ca AS code_a, p_cb AS code_b, CAST(p_cs AS DOUBLE) AS code_score, p AS score FROM {s_scored('(SELECT idx, local_a AS local_name, english_b AS english_name FROM v_owner WHERE local_a IS NOT NULL)', {'p': ('local_name', 'english_name')}, 'idx')}",
    "v_owner",
)
def name_match(spark: SparkSession, owners: DataFrame) -> DataFrame:
    """Detail of the comparison of each owner's name in the local script with the register's in the other."""
    pairs = owners.filter("local_a IS NOT NULL").select("idx", F.col("local_a").alias("local_name"), F.col("english_b").alias("english_name"))
    parts = T.name_parts(F.col("local_name"), F.col("english_name"))
    parts["distance"] = parts["distance"].cast("long")
    return pairs.select("idx", "local_name", "english_name", *[c.alias(n) for n, c in parts.items()])


OWNER = f"""SELECT idx, CASE WHEN missing THEN 'MISSING' WHEN same OR best >= 0.92 THEN 'MATCH' WHEN best >= 0.75 THEN 'PROBABLE' ELSE 'CONFLICT' END AS status, CASE WHEN missing THEN 0.0 WHEN same THEN 1.0 ELSE best END AS confidence FROM (
SELECT *, coalesce(english_a, '') = '' OR coalesce(english_b, '') = '' AS missing, coalesce(lower(trim(english_a)) = lower(trim(english_b)), FALSE) AS same,
 greatest(0.0, CASE WHEN coalesce(local_a, '') <> '' AND coalesce(local_b, '') <> '' THEN ll WHEN coalesce(local_a, '') <> '' THEN le WHEN coalesce(local_b, '') <> '' THEN el ELSE 0.0 END, ee) AS best
FROM {s_scored('v_owner', {'ll': ('local_a', 'local_b'), 'le': ('local_a', 'english_b'), 'el': ('local_b', 'english_a'), 'ee': ('english_a', 'english_b')}, 'idx')})"""


@query(f"SELECT idx, status, CAST(confidence AS DOUBLE) AS confidence FROM ({OWNER})", "v_owner")
def owner_reconcile(spark: SparkSession, owner: DataFrame) -> DataFrame:
    check = A.owner_check(*[F.col(c) for c in ("local_a", "english_a", "local_b", "english_b")])
    return owner.select("idx", check.alias("c")).select("idx", "c.status", "c.confidence")


AREA = f"""SELECT idx, recorded, surveyed, CASE WHEN gap IS NULL THEN 'MISSING' WHEN pct <= 3.5 THEN 'MATCH' ELSE 'CONFLICT' END AS status, gap AS difference, pct AS difference_pct FROM (
 SELECT *, CASE WHEN recorded > 0 THEN {s_rnd('gap / recorded * 100.0', 2)} WHEN gap IS NOT NULL THEN 0.0 END AS pct FROM (
 SELECT p.idx, r.recorded, p.surveyed, {s_rnd('abs(r.recorded - p.surveyed)', 2)} AS gap FROM v_surveyed p LEFT JOIN v_register r ON r.parcel_ref = p.idx))"""


def areas(parcels: DataFrame, register: DataFrame) -> DataFrame:
    both = parcels.join(register.select("parcel_ref", "recorded", "survey_no", "reg_idx"), parcels.idx == register.parcel_ref, "left")
    return both.withColumn("a", A.area_check(F.col("recorded"), F.col("surveyed")))


@query(f"SELECT idx, status, difference, difference_pct FROM ({AREA})", "v_surveyed", "v_register")
def area_reconcile(spark: SparkSession, parcels: DataFrame, register: DataFrame) -> DataFrame:
    return areas(parcels, register).select("idx", "a.status", "a.difference", "a.difference_pct")


PREFIX = "len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i)))"
IDENT = f"""SELECT idx, CASE WHEN coalesce(raw_a, '') = '' OR coalesce(raw_b, '') = '' THEN 'MISSING' WHEN a = b THEN 'MATCH' ELSE 'CONFLICT' END AS status,
 CASE WHEN coalesce(raw_a, '') = '' OR coalesce(raw_b, '') = '' THEN NULL WHEN a = b THEN 1.0 ELSE {s_rnd(f'{PREFIX} / greatest(length(a), length(b), 1)', 4)} END AS confidence
FROM (SELECT *, regexp_replace(upper(raw_a), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS a, regexp_replace(upper(raw_b), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS b FROM
 (SELECT p.idx, p.khasra_no AS raw_a, CASE WHEN p.idx % 3 = 0 THEN concat(CAST(r.survey_no AS STRING), '-', CAST(p.ward % 7 AS STRING)) WHEN p.idx % 3 = 1 THEN concat(CAST(r.survey_no AS STRING), '/', CAST(p.ward % 7 AS STRING), 'a') ELSE CAST(r.survey_no AS STRING) END AS raw_b FROM v_surveyed p LEFT JOIN v_register r ON r.parcel_ref = p.idx))"""


def numbers(parcels: DataFrame, register: DataFrame) -> DataFrame:
    b = areas(parcels, register)
    no, w = F.col("survey_no").cast("string"), (F.col("ward") % 7).cast("string")
    return b.withColumn("raw_b", F.when(F.col("survey_no").isNull(), F.when(F.col("idx") % 3 < 2, F.concat(F.when(F.col("idx") % 3 == 0, F.lit("-")).otherwise("/"), w, F.when(F.col("idx") % 3 == 1, "a").otherwise("")))).when(F.col("idx") % 3 == 0, F.concat(no, F.lit("-"), w)).when(F.col("idx") % 3 == 1, F.concat(no, F.lit("/"), w, F.lit("a"))).otherwise(no))


@query(f"SELECT idx, status, CAST(confidence AS DOUBLE) AS confidence FROM ({IDENT})", "v_surveyed", "v_register")
def identifier_reconcile(spark: SparkSession, parcels: DataFrame, register: DataFrame) -> DataFrame:
    return numbers(parcels, register).select("idx", A.identifier_check(F.col("khasra_no"), F.col("raw_b")).alias("c")).select("idx", "c.status", "c.confidence")


PARCEL = f"""SELECT o.idx, o.status AS owner_status, a.status AS area_status, i.status AS id_status,
 CASE WHEN 'CONFLICT' IN (o.status, a.status, i.status) THEN 'CONFLICT' WHEN o.status = 'MISSING' AND a.status = 'MISSING' AND i.status = 'MISSING' THEN 'MISSING' WHEN 'MISSING' IN (o.status, a.status, i.status) OR 'PROBABLE' IN (o.status, a.status, i.status) THEN 'PROBABLE' ELSE 'MATCH' END AS overall
FROM ({OWNER}) o JOIN ({AREA}) a ON a.idx = o.idx JOIN ({IDENT}) i ON i.idx = o.idx"""


def reconciled(owner: DataFrame, parcels: DataFrame, register: DataFrame) -> DataFrame:
    o = owner.select(F.col("idx").alias("o_idx"), A.owner_check(*[F.col(c) for c in ("local_a", "english_a", "local_b", "english_b")])["status"].alias("owner_status"))
    n = numbers(parcels, register).withColumn("i", A.identifier_check(F.col("khasra_no"), F.col("raw_b")))
    both = n.join(o, n.idx == o.o_idx).select("idx", "owner_status", F.col("a.status").alias("area_status"), F.col("i.status").alias("id_status"), "parcel_id", "ward")
    return both.withColumn("overall", A.overall(F.col("owner_status"), F.col("area_status"), F.col("id_status")))


@query(PARCEL, "v_owner", "v_surveyed", "v_register")
def parcel_reconcile(spark: SparkSession, owner: DataFrame, parcels: DataFrame, register: DataFrame) -> DataFrame:
    return reconciled(owner, parcels, register).select("idx", "owner_status", "area_status", "id_status", "overall")


@query(
    f"""SELECT idx, field, 'attribute_conflict' AS conflict_type, 'MEDIUM' AS severity, 'OPEN' AS status, concat_ws(',', 'cadastral', 'revenue') AS layers FROM (
 SELECT idx, 'owner_name' AS field, owner_status AS s FROM ({PARCEL}) UNION ALL SELECT idx, 'area', area_status FROM ({PARCEL}) UNION ALL SELECT idx, 'khasra_no', id_status FROM ({PARCEL})) WHERE s = 'CONFLICT'""",
    "v_owner", "v_surveyed", "v_register",
)
def conflict_from_checks(spark: SparkSession, owner: DataFrame, parcels: DataFrame, register: DataFrame) -> DataFrame:
    checks = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("s")) for f, c in (("owner_name", "owner_status"), ("area", "area_status"), ("khasra_no", "id_status"))])).alias("c")
    layers = F.array_join(F.array_sort(F.array_distinct(F.array(F.lit("revenue"), F.lit("cadastral")))), ",")
    return reconciled(owner, parcels, register).select("idx", checks).filter("c.s = 'CONFLICT'").select("idx", "c.field", F.lit("attribute_conflict").alias("conflict_type"), F.lit("MEDIUM").alias("severity"), F.lit("OPEN").alias("status"), layers.alias("layers"))


RAW_NUMBER = "CASE o_orderkey % 6 WHEN 0 THEN concat(' ', CAST(o_orderkey AS STRING), ',234.5 sq.m ') WHEN 1 THEN concat('-', CAST(o_custkey AS STRING), ' sqm') WHEN 2 THEN 'n/a' WHEN 3 THEN '-' WHEN 4 THEN concat('१२', CAST(o_custkey AS STRING)) ELSE '' END"


@query(
    f"SELECT o_orderkey AS idx, raw, TRY_CAST(regexp_replace(regexp_replace(lower(translate(raw, '०१२३४५६७८९', '0123456789')), 'sq\\.?\\s*m(?:eters?|etres?)?\\.?|sqm|m2|m²|,', '', 'g'), '[^0-9.\\-]', '', 'g') AS DOUBLE) AS value FROM (SELECT o_orderkey, {RAW_NUMBER} AS raw FROM orders)",
    "orders",
)
def coerce_numbers(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return orders.selectExpr("o_orderkey AS idx", f"{RAW_NUMBER} AS raw").withColumn("value", coerce_number(F.col("raw")))


STD = "nullif(trim(owner), '')"


@query(
    """SELECT c_custkey AS idx, nullif(trim(CASE WHEN c_custkey % 6 = 0 THEN '  ' ELSE concat(' ', c_name) END), '') AS owner_name, nullif(trim(c_mktsegment), '') AS land_use, CAST(c_nationkey AS STRING) AS ward,
 CAST(c_acctbal AS DOUBLE) AS recorded_area_sqm, CAST(to_json({'sheet': concat('S', CAST(c_custkey % 12 AS STRING))}) AS STRING) AS extra FROM customer""",
    "customer",
)
def standardize_records(spark: SparkSession, customer: DataFrame) -> DataFrame:
    """A source layer with headers of its own, in canonical columns; what has no role is kept as JSON."""
    from landloom.operators.standardize import standardise

    raw = customer.select(F.col("c_custkey").alias("idx"), F.when(F.col("c_custkey") % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name")).alias("Owner Name"), F.col("c_mktsegment").alias("Land Use"), F.col("c_nationkey").alias("Ward_No"), F.col("c_acctbal").alias("Legal Area"), F.concat(F.lit("S"), F.col("c_custkey") % 12).alias("sheet"))
    out = standardise(raw, keep=["idx"])
    return out.select("idx", "owner_name", "land_use", "ward", "recorded_area_sqm", F.to_json("extra").alias("extra"))


@query("""SELECT floor(avg(CASE WHEN nullif(trim(o.english_a), '') IS NULL THEN 0.0 ELSE 1.0 END) * 10000.0 + 0.5) / 10000.0 AS english_a, floor(avg(CASE WHEN nullif(trim(o.local_a), '') IS NULL THEN 0.0 ELSE 1.0 END) * 10000.0 + 0.5) / 10000.0 AS local_a, floor(avg(CASE WHEN nullif(trim(o.local_b), '') IS NULL THEN 0.0 ELSE 1.0 END) * 10000.0 + 0.5) / 10000.0 AS local_b FROM v_owner o""", "v_owner")
def fill_rate(spark: SparkSession, owner: DataFrame) -> DataFrame:
    from landloom.operators.standardize import fill_rates

    return fill_rates(owner, ["english_a", "local_a", "local_b"])


@query("SELECT field, filled FROM (SELECT 'english_a' AS field, bool_or(coalesce(trim(o.english_a), '') <> '') AS filled FROM v_owner o UNION ALL SELECT 'village', FALSE UNION ALL SELECT 'zone', FALSE) WHERE NOT filled", "v_owner")
def required_missing(spark: SparkSession, owner: DataFrame) -> DataFrame:
    from landloom.operators.standardize import never_filled

    wide = owner.withColumn("village", F.lit("  ")).withColumn("zone", F.lit(None).cast("string"))
    return never_filled(wide, ["english_a", "village", "zone"])


HEADERS = {
    "customer": ["owner", "ward_no", "village_name"],
    "parcel": ["Parcel ID", "ULPIN", "Khasra", "Owner Name", "Recorded Area", "Surveyed Area", "Local Name", "sheet", "Ward"],
    "register": ["parcel_id", "ulpin", "khasra_no", "owner", "owner_local", "type", "landuse", "area", "measured area", "ward", "village", "zone_name"],
    "roads": ["street", "width", "zone_name"],
}


def compatibility_sql() -> str:
    """The rule in SQL: each header takes the first alias that equals it in snake case; the layer's fields are counted."""
    from landloom.operators.standardize import ALIASES, REQUIRED

    heads = ", ".join(f"('{layer}', '{h}')" for layer, own in HEADERS.items() for h in own)
    aliases = ", ".join(f"('{a}', '{f}')" for f, own in ALIASES.items() for a in own)
    required = ", ".join(f"'{f}'" for f in REQUIRED)
    snake = "regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g')"
    n, need = len(ALIASES), len(REQUIRED)
    return f"""SELECT layer, CAST(total AS INT) AS mapped, floor(total * 10000.0 / {n} + 0.5) / 10000.0 AS score,
 CASE WHEN required = 0 THEN 'INCOMPATIBLE' WHEN required < {need} THEN 'PARTIAL' WHEN (total - required) >= {n - need} * 0.5 THEN 'COMPATIBLE' ELSE 'USABLE' END AS verdict FROM (
 SELECT h.layer, count(DISTINCT a.field) AS total, count(DISTINCT CASE WHEN a.field IN ({required}) THEN a.field END) AS required FROM (VALUES {heads}) h(layer, header) LEFT JOIN (VALUES {aliases}) a(alias, field) ON {snake.format('h.header')} = {snake.format('a.alias')} GROUP BY h.layer)"""


@query(compatibility_sql(), "region")
def schema_compat(spark: SparkSession, region: DataFrame) -> DataFrame:
    """Share of the canonical fields that the headers of some layers cover, and what follows from it."""
    from landloom.operators.standardize import compatibility

    return spark.createDataFrame([(k, *compatibility(v)) for k, v in HEADERS.items()], "layer string, mapped int, score double, verdict string")


@query("SELECT raw, role FROM (VALUES ('Khasra Number', 'khasra_no'), ('Owner Name', 'owner_name'), ('Deed Area', 'recorded_area_sqm'), ('GAON', 'village'), ('Street', 'road_ref'), ('LP_No', 'parcel_id')) t(raw, role)", "region")
def canonicalize_columns(spark: SparkSession, region: DataFrame) -> DataFrame:
    from landloom.operators.standardize import ALIASES

    found = {raw: T.match_header(raw, ALIASES) for raw in ("Khasra Number", "Owner Name", "Deed Area", "GAON", "Street", "LP_No", "remarks")}
    return spark.createDataFrame([(k, v) for k, v in found.items() if v], "raw string, role string")


@query("SELECT floor(count(*) FILTER (WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL) / count(*) * 1000.0 + 0.5) / 1000.0 AS numeric_ratio, count(*) AS cells FROM (SELECT unnest([CAST(s_suppkey AS STRING), s_name, CAST(s_acctbal AS STRING)]) AS v FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 50))", "supplier")
def numeric_cell_ratio(spark: SparkSession, supplier: DataFrame) -> DataFrame:
    from landloom.sources.tables import numeric_ratio

    head = supplier.orderBy("s_suppkey").limit(50).select("s_suppkey", "s_name", "s_acctbal")
    return numeric_ratio(head)


@query("SELECT c_custkey AS idx, concat('27', '025', lpad(CAST(c_nationkey AS STRING), 3, '0'), right(lpad(CAST(c_custkey AS STRING), 2, '0'), 2)) AS ulpin FROM customer", "customer")
def ulpin(spark: SparkSession, customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("idx"), T.land_number(F.lit(27), F.lit(25), F.col("c_nationkey"), F.col("c_custkey")).alias("ulpin"))


@query("SELECT c_custkey AS idx, upper(left(sha256(concat_ws('|', c_name, c_mktsegment, CAST(c_nationkey AS STRING))), 16)) AS code FROM customer", "customer")
def tamper_checksum(spark: SparkSession, customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("idx"), T.tamper_code(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("code"))


@query("SELECT p.parcel_id, lpad(right(regexp_replace(p.parcel_id, '[^0-9]', '', 'g'), 3), 3, '0') AS notice FROM v_parcel p", "v_parcel")
def notice_id(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    return parcels.select("parcel_id", T.notice_number(F.col("parcel_id")).alias("notice"))


LOOKUP = """WITH claims AS (SELECT reg_idx, recorded, 1 AS k, CAST(parcel_ref AS STRING) AS v FROM v_register_all UNION ALL SELECT reg_idx, recorded, 2, CAST(survey_no AS STRING) FROM v_register_all),
owned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY reg_idx, k) AS rn FROM claims) WHERE rn = 1)
SELECT p.idx, coalesce(a.reg_idx, b.reg_idx) AS reg_idx, CASE WHEN a.reg_idx IS NOT NULL THEN 'id' WHEN b.reg_idx IS NOT NULL THEN 'number' END AS found_by
FROM v_parcel p LEFT JOIN owned a ON a.v = CAST(p.idx AS STRING) LEFT JOIN owned b ON b.v = split_part(p.khasra_no, '/', 1)"""


@query(LOOKUP, "v_parcel", "v_register_all")
def ror_lookup_priority(spark: SparkSession, parcels: DataFrame, register: DataFrame) -> DataFrame:
    numbered = parcels.withColumn("no", F.substring_index("khasra_no", "/", 1))
    out = A.register_lookup(numbered, register, ["parcel_ref", "survey_no"], "idx", "no", "reg_idx")
    return out.select("idx", F.col("register.reg_idx").alias("reg_idx"), "found_by")


ROUTES = f"""SELECT status AS area_status, CASE WHEN overall >= 0.92 THEN 'AUTO_ACCEPTED' WHEN overall >= 0.75 THEN 'REVIEW_RECOMMENDED' ELSE 'FIELD_VERIFICATION_REQUIRED' END AS route, count(*) AS parcels, {s_rnd('CAST(sum(CAST(difference_pct AS DECIMAL(28,4))) AS DOUBLE) / count(difference_pct)', 4)} AS avg_difference_pct
FROM (SELECT *, {s_rnd("0.9 * 0.30 + 1.0 * 0.25 + area_score * 0.20 + 1.0 * 0.15 + 1.0 * 0.10", 4)} AS overall FROM (SELECT *, CASE WHEN recorded > 0 THEN {s_rnd('greatest(0.0, 1 - (abs(recorded - surveyed) / recorded * 100.0) / 7.0)', 4)} ELSE 0.0 END AS area_score FROM ({AREA}))) GROUP BY 1, 2"""


@query(ROUTES, "v_surveyed", "v_register")
def confidence_routes(spark: SparkSession, parcels: DataFrame, register: DataFrame) -> DataFrame:
    """The flagship: register lookup, area check, confidence and routes, counted."""
    one = F.lit(1.0)
    score = A.confidence(F.lit(0.9), F.lit(0.9), one, F.col("recorded"), F.col("surveyed"), F.lit(0), F.lit(0.0))
    scored = areas(parcels, register).withColumn("c", score)
    return scored.groupBy(F.col("a.status").alias("area_status"), F.col("c.route").alias("route")).agg(F.count(F.lit(1)).alias("parcels"), rnd(exact_sum(F.col("a.difference_pct")) / F.count("a.difference_pct"), 4).alias("avg_difference_pct"))


@query(f"SELECT l_orderkey AS idx, l_linenumber AS line, CASE WHEN l_extendedprice <= 0 THEN 0.0 ELSE {s_rnd('abs(l_extendedprice - l_quantity * 1500.0) / l_extendedprice', 6)} END AS variance FROM lineitem", "lineitem")
def area_variance(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    v = ratio(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500.0), F.col("l_extendedprice"))
    return lineitem.select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("line"), F.coalesce(rnd(v, 6), F.lit(0.0)).alias("variance"))
