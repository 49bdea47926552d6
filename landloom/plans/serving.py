"""Queries on datasets, quality, conflicts, changes, runs, reviews and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import geom as G
from landloom.functions.num import exact_sum, rnd
from landloom.operators import attributes as A
from landloom.operators import quality as Q
from landloom.operators import serving as V
from landloom.plans.attributes import s_rnd
from landloom.plans.registry import query


@query("SELECT count(*) AS features, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y, count(*) FILTER (WHERE (x1 - x0) * (y1 - y0) > 40) AS valid, count(*) FILTER (WHERE x0 IS NULL) AS nulls FROM (SELECT *, CASE WHEN b_idx % 3 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind FROM v_structure)", "v_structure")
def layer_report(spark: SparkSession, structures: DataFrame) -> DataFrame:
    kind = F.when(F.col("b_idx") % 3 == 0, "MultiPolygon").otherwise("Polygon")
    return Q.layer_report(structures, kind, G.box(), G.box_area(G.box()) > 40)


@query(f"SELECT band, count(*) AS cells, min(v) AS least, max(v) AS largest, {s_rnd('CAST(sum(CAST(v AS DECIMAL(28,8))) AS DOUBLE) / count(*)', 4)} AS mean FROM (SELECT label AS band, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WHERE v >= 0 GROUP BY band", "embeddings")
def band_stats(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    cells = vectors.select(F.col("label").alias("band"), F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    v = F.col("v")
    return cells.filter("v >= 0").groupBy("band").agg(F.count(v).alias("cells"), F.min(v).alias("least"), F.max(v).alias("largest"), rnd(exact_sum(v, 8) / F.count(v), 4).alias("mean"))


@query("SELECT id, category_id, record_count, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, seq DESC) AS rn, min(seq) OVER (PARTITION BY id) AS first_seen FROM v_dataset) WHERE rn = 1", "v_dataset")
def registry_latest(spark: SparkSession, datasets: DataFrame) -> DataFrame:
    return Q.latest(datasets, "id", ["version", "seq"], "seq").select("id", "category_id", "record_count", "first_seen")


CATEGORIES = ("cadastral_map", "revenue_records", "building_footprint", "gnss_cors", "ground_truthing", "municipal_gis", "utility_network", "ortho_ori", "dsm_dtm", "drone_imagery")


@query(f"SELECT c AS category_id, count(d.seq) AS datasets, CAST(coalesce(sum(coalesce(d.record_count, 0)), 0) AS BIGINT) AS records, count(d.seq) > 0 AS populated FROM (SELECT unnest([{', '.join(map(repr, CATEGORIES))}]) AS c) LEFT JOIN v_dataset d ON d.category_id = c GROUP BY c", "v_dataset")
def coverage_report(spark: SparkSession, datasets: DataFrame) -> DataFrame:
    all_ = spark.createDataFrame([(c,) for c in CATEGORIES], "category_id string")
    by = datasets.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("record_count", F.lit(0))).alias("r"))
    n = F.coalesce("n", F.lit(0))
    return all_.join(by, "category_id", "left").select("category_id", n.alias("datasets"), F.coalesce("r", F.lit(0)).alias("records"), (n > 0).alias("populated"))


FOUND = """SELECT seq, kind, unnest(list_filter([CASE WHEN NOT parse_ok THEN 'PARSE_FAILED:critical' END, CASE WHEN crs_status = 'missing' THEN 'CRS_MISSING:critical' END, CASE WHEN crs_status = 'inferred' THEN 'CRS_INFERRED:warning' END, CASE WHEN record_count IS NULL THEN 'RECORD_COUNT_UNKNOWN:warning' END,
 CASE WHEN record_count = 0 THEN 'EMPTY_DATASET:error' END, CASE WHEN kind = 'vector' AND nulls > 0 THEN 'NULL_GEOMETRY:error' END, CASE WHEN kind = 'vector' AND invalid > 0 THEN 'INVALID_GEOMETRY:error' END], lambda x: x IS NOT NULL)) AS i FROM v_dataset"""
BY_SEVERITY = ", ".join(f"count(*) FILTER (WHERE split_part(i, ':', 2) = '{s}') AS {s}" for s in Q.SEVERITIES)


@query(f"SELECT split_part(i, ':', 1) AS code, {BY_SEVERITY} FROM ({FOUND}) GROUP BY 1", "v_dataset")
def issue_counts(spark: SparkSession, datasets: DataFrame) -> DataFrame:
    return Q.severity_counts(Q.issues(datasets), "code")


@query(f"SELECT d.seq, coalesce(critical, 0) AS critical, coalesce(error, 0) AS error, coalesce(warning, 0) AS warning, CASE WHEN critical > 0 THEN 'failed' WHEN error > 0 OR warning > 0 THEN 'warning' ELSE 'passed' END AS status FROM v_dataset d LEFT JOIN (SELECT seq, {BY_SEVERITY} FROM ({FOUND}) GROUP BY seq) f ON f.seq = d.seq", "v_dataset")
def dataset_status(spark: SparkSession, datasets: DataFrame) -> DataFrame:
    n = Q.severity_counts(Q.issues(datasets), "seq")
    out = datasets.select("seq").join(n, "seq", "left").na.fill(0)
    return out.select("seq", "critical", "error", "warning", Q.status(F.col("critical"), F.col("error"), F.col("warning")).alias("status"))


@query(f"SELECT sum(critical)::BIGINT AS critical, sum(error)::BIGINT AS error, sum(warning)::BIGINT AS warning, sum(info)::BIGINT AS info, sum(critical) > 0 AS blocking FROM (SELECT {BY_SEVERITY} FROM ({FOUND}) GROUP BY seq)", "v_dataset")
def issue_rollup(spark: SparkSession, datasets: DataFrame) -> DataFrame:
    return Q.severity_counts(Q.issues(datasets)).withColumn("blocking", F.col("critical") > 0)


@query(
    f"""SELECT seq, score_pct, CASE WHEN NOT parse_ok OR n <= 0 THEN 'BLOCKED' WHEN score_pct >= 85 THEN 'PASS' WHEN score_pct >= 65 THEN 'PASS_WITH_WARNINGS' ELSE 'BLOCKED' END AS verdict FROM (SELECT *, {s_rnd('(geometry * 0.28 + crs * 0.22 + filled * 0.22 + uniq * 0.14 + cover * 0.14) * 100.0', 1)} AS score_pct FROM (
SELECT *, CASE WHEN n > 0 THEN greatest(0.0::DOUBLE, 1 - invalid / n) ELSE 0.0::DOUBLE END AS geometry, CASE WHEN kind = 'table' OR crs_status <> 'missing' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS crs, CASE WHEN kind = 'table' OR has_bounds THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cover,
 CASE WHEN fill > 0 THEN fill::DOUBLE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS filled, greatest(0.0::DOUBLE, 1 - duplicates / 10.0::DOUBLE) AS uniq FROM (SELECT *, coalesce(record_count, 0) AS n FROM v_dataset)))""",
    "v_dataset",
)
def quality_gate(spark: SparkSession, datasets: DataFrame) -> DataFrame:
    return Q.gate(datasets.withColumn("fill", F.col("fill").cast("double"))).select("seq", "score_pct", "verdict")


CRS = "CASE WHEN {h} IS NOT NULL THEN {a} WHEN {d} IS NOT NULL THEN {b} WHEN x <= 180 AND y <= 90 THEN {c} WHEN greatest(x, y) > 180 THEN {e} ELSE {f} END"
CRS_IN = "SELECT c_custkey AS idx, CASE WHEN c_custkey % 5 = 0 THEN 32643 END AS h, CASE WHEN c_custkey % 3 = 0 THEN 4326 END AS d, abs(c_acctbal) / CASE WHEN c_custkey % 2 = 0 THEN 100.0 ELSE 1.0 END AS x, abs(c_acctbal) / CASE WHEN c_custkey % 4 = 0 THEN 100.0 ELSE 60.0 END AS y FROM customer"


@query(f"SELECT idx, CAST({CRS.format(h='h', d='d', a='h', b='d', c='4326', e='32643', f='NULL')} AS INTEGER) AS srid, CAST({CRS.format(h='h', d='d', a='1.0', b='0.9', c='0.55', e='0.35', f='0.0')} AS DOUBLE) AS confidence, " + CRS.format(h="h", d="d", a="'detected'", b="'declared'", c="'inferred'", e="'inferred'", f="'missing'") + f" AS status FROM ({CRS_IN})", "customer")
def crs_detect(spark: SparkSession, customer: DataFrame) -> DataFrame:
    src = customer.selectExpr("c_custkey AS idx", "CASE WHEN c_custkey % 5 = 0 THEN 32643 END AS h", "CASE WHEN c_custkey % 3 = 0 THEN 4326 END AS d", "abs(c_acctbal) / CASE WHEN c_custkey % 2 = 0 THEN 100.0D ELSE 1.0D END AS x", "abs(c_acctbal) / CASE WHEN c_custkey % 4 = 0 THEN 100.0D ELSE 60.0D END AS y")
    return src.select("idx", Q.detect_crs(F.col("h"), F.col("d"), F.col("x"), F.col("y")).alias("c")).select("idx", "c.*")


@query("SELECT parcel_id, change_type FROM (SELECT parcel_id, 'NEW' AS change_type FROM (SELECT parcel_id FROM v_epoch2 EXCEPT SELECT parcel_id FROM v_epoch1) UNION ALL SELECT parcel_id, 'REMOVED' FROM (SELECT parcel_id FROM v_epoch1 EXCEPT SELECT parcel_id FROM v_epoch2))", "v_epoch1", "v_epoch2")
def presence_changes(spark: SparkSession, one: DataFrame, two: DataFrame) -> DataFrame:
    return V.presence_changes(one, two, "parcel_id")


LAND = "SELECT a.parcel_id, a.land_use AS previous_value, b.land_use AS current_value, CAST(0.9 AS DOUBLE) AS confidence FROM v_epoch1 a JOIN v_epoch2 b ON b.parcel_id = a.parcel_id WHERE lower(trim(a.land_use)) <> lower(trim(b.land_use)) AND a.land_use <> '' AND b.land_use <> ''"


def land_changes(one: DataFrame, two: DataFrame) -> DataFrame:
    both = one.select("parcel_id", F.col("land_use").alias("previous_value")).join(two.select("parcel_id", F.col("land_use").alias("current_value")), "parcel_id")
    differs = (F.lower(F.trim("previous_value")) != F.lower(F.trim("current_value"))) & (F.col("previous_value") != "") & (F.col("current_value") != "")
    return both.filter(differs).withColumn("confidence", F.lit(0.9))


@query(LAND, "v_epoch1", "v_epoch2")
def land_use_change(spark: SparkSession, one: DataFrame, two: DataFrame) -> DataFrame:
    return land_changes(one, two)


@query(f"SELECT change_type, count(*) AS n FROM (SELECT 'LAND_USE_CHANGE' AS change_type FROM ({LAND}) UNION ALL SELECT 'NEW' FROM (SELECT parcel_id FROM v_epoch2 EXCEPT SELECT parcel_id FROM v_epoch1) UNION ALL SELECT 'REMOVED' FROM (SELECT parcel_id FROM v_epoch1 EXCEPT SELECT parcel_id FROM v_epoch2)) GROUP BY 1", "v_epoch1", "v_epoch2")
def change_summary(spark: SparkSession, one: DataFrame, two: DataFrame) -> DataFrame:
    land = land_changes(one, two).select(F.lit("LAND_USE_CHANGE").alias("change_type"))
    return land.union(V.presence_changes(one, two, "parcel_id").select("change_type")).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'conflict_type' AS dimension, conflict_type AS value, count(*) AS n FROM v_conflict GROUP BY conflict_type UNION ALL SELECT 'severity', severity, count(*) FROM v_conflict GROUP BY severity UNION ALL SELECT 'status', status, count(*) FROM v_conflict GROUP BY status UNION ALL SELECT 'all', 'all', count(*) FROM v_conflict", "v_conflict")
def conflict_summary(spark: SparkSession, conflicts: DataFrame) -> DataFrame:
    return V.grouped_counts(conflicts, "conflict_type", "severity", "status")


@query("SELECT id, conflict_type, severity, status FROM v_conflict WHERE conflict_type = 'parcel_vs_drainage' AND upper(severity) = 'HIGH' AND upper(status) = 'OPEN' ORDER BY idx LIMIT 50 OFFSET 10", "v_conflict")
def conflict_filter_page(spark: SparkSession, conflicts: DataFrame) -> DataFrame:
    hit = conflicts.filter((F.col("conflict_type") == "parcel_vs_drainage") & (F.upper("severity") == "HIGH") & (F.upper("status") == "OPEN"))
    return V.page(hit, 10, 50, F.col("idx")).select("id", "conflict_type", "severity", "status")


@query("SELECT p.parcel_id, p.khasra_no, p.owner_name, p.balance FROM v_parcel p WHERE contains(lower(p.parcel_id), '00') OR contains(lower(p.khasra_no), '00') OR contains(lower(p.owner_name), '00') ORDER BY p.balance DESC, p.parcel_id LIMIT 25 OFFSET 5", "v_parcel")
def parcel_search_page(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    hits = V.search(parcels, "00", ["parcel_id", "khasra_no", "owner_name"])
    return V.page(hits, 5, 25, F.col("balance").desc(), F.col("parcel_id")).select("parcel_id", "khasra_no", "owner_name", "balance")


SCORED = f"""SELECT l_orderkey AS idx, l_linenumber AS line, {s_rnd("least(1.0::DOUBLE, greatest(0.0::DOUBLE, geometry * 0.30::DOUBLE + attribute * 0.25::DOUBLE + area * 0.20::DOUBLE + topology * 0.15::DOUBLE + support * 0.10::DOUBLE))", 4)} AS overall, iou, att, rec, sur, issues, dist FROM (
SELECT *, {s_rnd('iou', 4)} AS geometry, {s_rnd('least(1.0::DOUBLE, greatest(0.0::DOUBLE, att))', 4)} AS attribute, CASE WHEN rec > 0 AND sur <> 0 THEN {s_rnd('greatest(0.0::DOUBLE, 1 - abs(rec - sur) / rec * 100.0::DOUBLE / 7.0::DOUBLE)', 4)} ELSE 0.0 END AS area, {s_rnd('greatest(0.0::DOUBLE, 1 - issues / 3.0::DOUBLE)', 4)} AS topology, {s_rnd('greatest(0.0::DOUBLE, 1 - dist / 3.0::DOUBLE)', 4)} AS support FROM (
SELECT l_orderkey, l_linenumber, 1 - l_discount * 3 AS iou, 1 - l_tax * 2 AS att, l_extendedprice AS rec, l_extendedprice * (1 + l_tax / 2) AS sur, l_linenumber % 3 AS issues, l_quantity / 25 AS dist FROM lineitem))"""
NONE = "cast(NULL AS double)"


def signals(lineitem: DataFrame) -> tuple[DataFrame, list]:
    df = lineitem.select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("line"), (1 - F.col("l_discount") * 3).alias("iou"), (1 - F.col("l_tax") * 2).alias("att"), F.col("l_extendedprice").alias("rec"), (F.col("l_extendedprice") * (1 + F.col("l_tax") / 2)).alias("sur"), (F.col("l_linenumber") % 3).alias("issues"), (F.col("l_quantity") / 25).alias("dist"))
    return df, [F.col("iou"), F.expr(NONE), *[F.col(c) for c in ("att", "rec", "sur", "issues", "dist")]]


def confident(lineitem: DataFrame) -> DataFrame:
    df, s = signals(lineitem)
    return df.withColumn("c", A.confidence(*s)).select("*", "c.overall", "c.route")


ROUTE = "CASE WHEN overall >= 0.92 THEN 'AUTO_ACCEPTED' WHEN overall >= 0.75 THEN 'REVIEW_RECOMMENDED' ELSE 'FIELD_VERIFICATION_REQUIRED' END"


@query(f"SELECT idx, line, overall, {ROUTE} AS route FROM ({SCORED})", "lineitem")
def confidence_score(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    return confident(lineitem).select("idx", "line", "overall", "route")


DELTA = "abs(rec - sur) / rec * 100.0"
PASSED = f"list_filter([CASE WHEN iou >= 0.75 THEN 'Boundary similarity' END, CASE WHEN att >= 0.80 THEN 'Attribute match' END, CASE WHEN {DELTA} <= 3.5 THEN 'Area difference' END, CASE WHEN issues = 0 THEN 'Valid topology' END, CASE WHEN dist <= 3.0 THEN 'Survey point support' END], lambda x: x IS NOT NULL)"
CONCERN = f"list_filter([CASE WHEN iou < 0.55 THEN 'Low boundary overlap' END, CASE WHEN att < 0.80 THEN 'Attribute disagreement' END, CASE WHEN {DELTA} > 3.5 THEN 'Area difference' END, CASE WHEN issues <> 0 THEN 'Topology issues' END, CASE WHEN dist > 3.0 THEN 'Weak survey support' END], lambda x: x IS NOT NULL)"


@query(f"SELECT idx, line, array_to_string({PASSED}, ', ') AS passed, array_to_string({CONCERN}, ', ') AS concerns FROM ({SCORED})", "lineitem")
def confidence_evidence(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    df, s = signals(lineitem)
    passed, concerns = A.evidence(*s)
    return df.select("idx", "line", F.array_join(passed, ", ").alias("passed"), F.array_join(concerns, ", ").alias("concerns"))


@query(
    f"""SELECT count(overall) AS n, min(overall) AS least, max(overall) AS largest, {s_rnd('CAST(sum(CAST(overall AS DECIMAL(28,6))) AS DOUBLE) / count(overall)', 4)} AS mean, count(*) FILTER (WHERE overall >= 0.90) AS band_90, count(*) FILTER (WHERE overall >= 0.75 AND overall < 0.90) AS band_75, count(*) FILTER (WHERE overall >= 0.50 AND overall < 0.75) AS band_50, count(*) FILTER (WHERE overall < 0.50) AS band_0,
 count(*) FILTER (WHERE overall >= 0.92) AS auto_accepted, count(*) FILTER (WHERE overall >= 0.75 AND overall < 0.92) AS review_recommended, count(*) FILTER (WHERE overall < 0.75) AS field_verification_required FROM ({SCORED})""",
    "lineitem",
)
def confidence_distribution(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    return A.distribution(confident(lineitem), "overall", "route")


@query(f"SELECT CASE WHEN issues > 0 THEN 'TOPOLOGY_ISSUE' ELSE {ROUTE} END AS status, count(*) AS n FROM ({SCORED}) GROUP BY 1", "lineitem")
def route_status(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    state = F.when(F.col("issues") > 0, "TOPOLOGY_ISSUE").otherwise(F.col("route"))
    return confident(lineitem).groupBy(state.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p.parcel_id, coalesce(c.n, 0) AS conflicts, coalesce(c.open_n, 0) AS open_conflicts, coalesce(b.n, 0) AS buildings, coalesce(s.n, 0) AS observations, r.reg_idx FROM v_parcel p LEFT JOIN (SELECT parcel_ref, count(*) AS n, count(*) FILTER (WHERE status = 'OPEN') AS open_n FROM v_conflict GROUP BY parcel_ref) c ON c.parcel_ref = p.idx
LEFT JOIN (SELECT hint, count(*) AS n FROM v_structure GROUP BY hint) b ON b.hint = p.idx LEFT JOIN (SELECT parcel, count(*) AS n FROM v_survey GROUP BY parcel) s ON s.parcel = p.idx LEFT JOIN v_register r ON r.parcel_ref = p.idx""",
    "v_parcel", "v_conflict", "v_structure", "v_survey", "v_register",
)
def dossier_star(spark: SparkSession, parcels: DataFrame, conflicts: DataFrame, structures: DataFrame, survey: DataFrame, register: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).alias("n")
    c = conflicts.groupBy(F.col("parcel_ref").alias("idx")).agg(n.alias("conflicts"), F.count_if(F.col("status") == "OPEN").alias("open_conflicts"))
    b = structures.groupBy(F.col("hint").alias("idx")).agg(n.alias("buildings"))
    s = survey.groupBy(F.col("parcel").alias("idx")).agg(n.alias("observations"))
    r = register.select(F.col("parcel_ref").alias("idx"), "reg_idx")
    star = parcels.select("idx", "parcel_id").join(c, "idx", "left").join(b, "idx", "left").join(s, "idx", "left").join(r, "idx", "left")
    return star.select("parcel_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("conflicts", "open_conflicts", "buildings", "observations")], "reg_idx")


@query("SELECT p.parcel_id, p.land_use, b.building_id FROM v_parcel p LEFT JOIN (SELECT hint, min_by(building_id, b_idx) AS building_id FROM v_structure GROUP BY hint) b ON b.hint = p.idx WHERE p.idx % 3 = 0", "v_parcel", "v_structure")
def export_features(spark: SparkSession, parcels: DataFrame, structures: DataFrame) -> DataFrame:
    """Requested parcels (a semi-join) with their first child."""
    wanted = parcels.filter("idx % 3 = 0").select("idx")
    first = structures.groupBy(F.col("hint").alias("idx")).agg(F.min_by("building_id", "b_idx").alias("building_id"))
    return parcels.join(wanted, "idx", "left_semi").join(first, "idx", "left").select("parcel_id", "land_use", "building_id")


@query("SELECT max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS run FROM orders WHERE o_orderstatus = 'F'", "orders")
def run_latest(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return orders.filter("o_orderstatus = 'F'").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events ORDER BY ts DESC, event_id LIMIT 200", "events")
def runs_decorated(spark: SparkSession, events: DataFrame) -> DataFrame:
    top = events.orderBy(F.col("ts").desc(), "event_id").limit(200)
    return top.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query("SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 'Surveyor' WHEN 'assistant' THEN 'Reviewer' ELSE 'System' END AS label FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 200", "conversations")
def audit_newest(spark: SparkSession, log: DataFrame) -> DataFrame:
    top = log.orderBy(F.col("conv_id").desc(), F.col("turn").desc()).limit(200)
    return top.select("conv_id", "turn", "role", F.when(F.col("role") == "user", "Surveyor").when(F.col("role") == "assistant", "Reviewer").otherwise("System").alias("label"))


FIELDS = {"khasra_no": "revenue", "owner_name": "revenue", "land_use": "revenue", "ward": "municipal", "balance": "cadastral"}
LONG = " UNION ALL ".join(f"SELECT p.idx, '{f}' AS field, CAST(p.{f} AS STRING) AS value, '{s}' AS source FROM v_parcel p WHERE CAST(p.{f} AS STRING) NOT IN ('', '0', '0.0')" for f, s in FIELDS.items())


@query(f"SELECT idx, field, source FROM ({LONG})", "v_parcel")
def field_lineage_unpivot(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    return V.lineage(parcels, "idx", FIELDS).select("idx", "field", "source")


@query(f"SELECT source, count(*) AS field_count, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM ({LONG}) GROUP BY source", "v_parcel")
def lineage_by_layer(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    long = V.lineage(parcels, "idx", FIELDS)
    return long.groupBy("source").agg(F.count(F.lit(1)).alias("field_count"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


TARGET = "CASE idx % 4 WHEN 0 THEN 'UNDER_REVIEW' WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'OPEN' ELSE 'RESOLVED' END"
MAY = " OR ".join(f"(status = '{k}' AND target IN ({', '.join(map(repr, v))}))" for k, v in V.TRANSITIONS.items())


@query(f"SELECT id, status, target, {MAY} AS ok FROM (SELECT *, {TARGET} AS target FROM v_conflict)", "v_conflict")
def transition_check(spark: SparkSession, conflicts: DataFrame) -> DataFrame:
    return conflicts.selectExpr("id", "status", f"{TARGET} AS target").withColumn("ok", V.allowed(F.col("status"), F.col("target")))


@query(f"SELECT id, CASE WHEN idx % 10 = 0 AND ({MAY}) THEN target ELSE status END AS status FROM (SELECT *, {TARGET} AS target FROM v_conflict)", "v_conflict")
def review_apply(spark: SparkSession, conflicts: DataFrame) -> DataFrame:
    """Decisions that the state machine allows, written over the conflicts by id."""
    decided = conflicts.filter("idx % 10 = 0").withColumn("target", F.expr(TARGET)).filter(V.allowed(F.col("status"), F.col("target")))
    new = decided.select("id", F.col("target").alias("status"))
    return V.upsert(conflicts.select("id", "status"), new, "id")


@query(f"""SELECT count(*) AS parcels, count(*) FILTER (WHERE approved) AS approved, {s_rnd('count(*) FILTER (WHERE approved) / count(*) * 100.0', 1)} AS rate, (SELECT count(*) FROM v_conflict c WHERE c.status <> 'RESOLVED' AND c.parcel_ref % 5 <> 0) AS active FROM (SELECT p.idx % 5 = 0 OR p.balance > 5000 AS approved FROM v_parcel p)""", "v_parcel", "v_conflict")
def approve_parcel_kpis(spark: SparkSession, parcels: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Figures after every fifth parcel is approved and its conflicts are dropped."""
    done = parcels.filter("idx % 5 = 0").select(F.col("idx").alias("parcel_ref"))
    k = parcels.agg(F.count(F.lit(1)).alias("parcels"), F.count_if((F.col("idx") % 5 == 0) | (F.col("balance") > 5000)).alias("approved"))
    active = conflicts.filter("status <> 'RESOLVED'").join(done, "parcel_ref", "left_anti").agg(F.count(F.lit(1)).alias("active"))
    return k.crossJoin(F.broadcast(active)).select("parcels", "approved", rnd(F.col("approved") / F.col("parcels") * 100.0, 1).alias("rate"), "active")  # one row each


def s_sector(total: int, rate: float) -> str:
    side = int(total**0.5) + (int(total**0.5) ** 2 < total)
    k = int(total * rate + 0.5)
    step = max(1, total // (k + 2))
    return f"""SELECT i, CAST(floor((i - 1) / {side}) AS BIGINT) AS r, (i - 1) % {side} AS c, {s_rnd('0.00026 * (0.86 + 0.06 * sin(3.1 * i)) * 0.00022 * (0.86 + 0.06 * cos(4.2 * i)) * 12321000000.0', 1)} AS surveyed,
 i IN (SELECT least({total} - 2, (j + 1) * {step} + (7 * j) % 5) FROM (SELECT unnest(range(0, {k})) AS j)) AS encroaching FROM (SELECT unnest(range(1, {total + 1})) AS i)"""


@query(" UNION ALL ".join(f"SELECT '{n}' AS sector, count(*) AS parcels, count(*) FILTER (WHERE encroaching) AS encroaching, {s_rnd('CAST(sum(CAST(surveyed AS DECIMAL(18,1))) AS DOUBLE)', 1)} AS surveyed, max(r) AS last_row FROM ({s_sector(t, q)})" for n, t, q in (("north", 1420, 0.0239), ("central", 980, 0.0184), ("south", 2150, 0.0289))), "region")
def sector_kpis(spark: SparkSession, region: DataFrame) -> DataFrame:
    from landloom.sources.generators import sector

    out = None
    for name, total, rate in (("north", 1420, 0.0239), ("central", 980, 0.0184), ("south", 2150, 0.0289)):
        one = sector(spark, total, rate).agg(F.count(F.lit(1)).alias("parcels"), F.count_if("encroaching").alias("encroaching"), rnd(exact_sum(F.col("surveyed"), 1), 1).alias("surveyed"), F.max("r").alias("last_row")).select(F.lit(name).alias("sector"), "*")
        out = one if out is None else out.union(one)
    return out


@query(" UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n FROM {t}" for t in ("customer", "orders", "part", "supplier")), "customer", "orders", "part", "supplier")
def store_health(spark: SparkSession, *tables: DataFrame) -> DataFrame:
    out = None
    for name, df in zip(("customer", "orders", "part", "supplier"), tables, strict=True):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
        out = one if out is None else out.union(one)
    return out
