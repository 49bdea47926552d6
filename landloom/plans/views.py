"""Land-record relations derived from the driver's tables, by SQL text that Spark and DuckDB both run.

The same text defines a relation in a query and, as a common table expression, in its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # One cell of a 40-column grid a customer, a little shrunk and shifted so that neighbours touch, overlap or leave gaps.
    "v_parcel": """SELECT c_custkey AS idx, concat('P', lpad(CAST(c_custkey AS STRING), 6, '0')) AS parcel_id,
 (c_custkey % 40) * 26.0 + (c_nationkey % 5) * 0.5 AS x0, CAST(FLOOR(c_custkey / 40) AS BIGINT) * 22.0 + (c_nationkey % 3) * 0.5 AS y0,
 (c_custkey % 40) * 26.0 + (c_nationkey % 5) * 0.5 + 26.0 * (0.9 + 0.01 * (c_custkey % 17)) AS x1,
 CAST(FLOOR(c_custkey / 40) AS BIGINT) * 22.0 + (c_nationkey % 3) * 0.5 + 22.0 * (0.9 + 0.01 * (c_custkey % 13)) AS y1,
 concat(CAST(c_custkey % 300 AS STRING), '/', CAST(c_nationkey % 7 AS STRING)) AS khasra_no, c_name AS owner_name, c_mktsegment AS land_use, c_nationkey AS ward, c_acctbal AS balance FROM customer""",
    "v_surveyed": "SELECT *, CAST(26.0 * 22.0 * (0.86 + 0.01 * (idx % 13)) AS DOUBLE) AS surveyed FROM v_parcel",
    "v_register_all": """SELECT o_orderkey AS reg_idx, o_custkey AS parcel_ref, o_custkey % 300 AS survey_no, o_orderstatus AS state, o_totalprice AS price,
 26.0 * 22.0 * (0.86 + 0.01 * (o_custkey % 13)) * (1 + 0.0028 * ((13 * o_orderkey) % 45 - 22)) AS recorded FROM orders""",
    "v_register": "SELECT * FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY parcel_ref ORDER BY reg_idx) AS rn FROM v_register_all r) x WHERE rn = 1",
    # Modern outlines: the parcels moved by a few decimetres; every seventh is missing, every eleventh far away.
    "v_candidate": """SELECT idx AS cand_idx, concat('M', lpad(CAST(idx AS STRING), 6, '0')) AS cand_id,
 x0 + (idx % 9) * 0.25 + CASE WHEN idx % 11 = 0 THEN 30.0 ELSE 0.0 END AS x0, y0 + (idx % 4) * 0.25 AS y0,
 x1 + (idx % 6) * 0.25 + CASE WHEN idx % 11 = 0 THEN 30.0 ELSE 0.0 END AS x1, y1 + (idx % 5) * 0.25 AS y1 FROM v_parcel WHERE idx % 7 <> 3""",
    # Footprints inside their customer's cell, some across its edge.
    "v_structure": """SELECT o_orderkey AS b_idx, concat('B', CAST(o_orderkey AS STRING)) AS building_id, o_custkey AS hint,
 (o_custkey % 40) * 26.0 + 3.0 + (o_orderkey % 19) * 1.0 AS x0, CAST(FLOOR(o_custkey / 40) AS BIGINT) * 22.0 + 2.0 + (o_orderkey % 5) * 1.5 AS y0,
 (o_custkey % 40) * 26.0 + 3.0 + (o_orderkey % 19) * 1.0 + 6.0 + (o_orderkey % 4) * 0.5 AS x1, CAST(FLOOR(o_custkey / 40) AS BIGINT) * 22.0 + 2.0 + (o_orderkey % 5) * 1.5 + 5.0 + (o_orderkey % 3) * 1.0 AS y1 FROM orders""",
    # Bands along the grid: a road, a drain or a utility line each, already with their width.
    "v_corridor": """SELECT n_nationkey AS c_idx, concat('C', CAST(n_nationkey AS STRING)) AS corridor_id, CASE WHEN n_nationkey % 3 = 0 THEN 'parcel_vs_road_row' WHEN n_nationkey % 3 = 1 THEN 'parcel_vs_drainage' ELSE 'parcel_vs_utility' END AS conflict_type,
 CASE WHEN n_nationkey % 3 = 0 THEN 7.0 WHEN n_nationkey % 3 = 1 THEN 3.0 ELSE 2.0 END AS buffer_m,
 CASE WHEN n_nationkey % 2 = 0 THEN 0.0 ELSE n_nationkey * 41.0 END AS x0, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 33.0 ELSE 0.0 END AS y0,
 CASE WHEN n_nationkey % 2 = 0 THEN 1040.0 ELSE n_nationkey * 41.0 + 2.0 + n_nationkey % 3 END AS x1, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 33.0 + 2.0 + n_nationkey % 3 ELSE 840.0 END AS y1 FROM nation""",
    # Observations of parcel corners: five event types stand for corners C1 to C5, the value for the accuracy.
    "v_survey": """SELECT event_id AS obs_idx, user_id AS parcel, CASE event_type WHEN 'click' THEN 'C1' WHEN 'view' THEN 'C2' WHEN 'purchase' THEN 'C3' WHEN 'signup' THEN 'C4' ELSE 'C5' END AS corner, value AS accuracy,
 (user_id % 40) * 26.0 + (event_id % 7) * 0.125 + CASE WHEN event_type IN ('view', 'purchase') THEN 23.0 ELSE 1.0 END AS x,
 CAST(FLOOR(user_id / 40) AS BIGINT) * 22.0 + (event_id % 5) * 0.125 + CASE WHEN event_type IN ('purchase', 'signup') THEN 19.0 ELSE 1.0 END AS y,
 CASE WHEN event_id % 3 = 0 THEN 'ground_truthing' ELSE 'gnss_cors' END AS source FROM events""",
    "v_conflict": """SELECT o_orderkey AS idx, concat('X', CAST(o_orderkey AS STRING)) AS id, o_custkey AS parcel_ref, CASE o_orderkey % 6 WHEN 0 THEN 'attribute_conflict' WHEN 1 THEN 'parcel_vs_road_row' WHEN 2 THEN 'parcel_vs_drainage' WHEN 3 THEN 'parcel_vs_utility' WHEN 4 THEN 'building_vs_parcel' ELSE 'boundary_divergence' END AS conflict_type,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'RESOLVED' ELSE 'UNDER_REVIEW' END AS status, o_totalprice AS weight FROM orders""",
    "v_epoch1": "SELECT p_partkey AS idx, concat('E', CAST(p_partkey AS STRING)) AS parcel_id, p_type AS land_use, p_size AS size FROM part WHERE p_partkey % 10 <> 3",
    "v_epoch2": "SELECT p_partkey AS idx, concat('E', CAST(p_partkey AS STRING)) AS parcel_id, CASE WHEN p_partkey % 8 = 1 THEN p_brand ELSE concat(' ', upper(p_type), ' ') END AS land_use, p_size + CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 3 ELSE 0 END AS size FROM part WHERE p_partkey % 10 <> 7",
    # Datasets of a catalogue: one a supplier, in ten categories.
    "v_dataset": """SELECT s_suppkey AS seq, concat('ds-', CAST(s_suppkey % 60 AS STRING)) AS id, CASE s_suppkey % 10 WHEN 0 THEN 'cadastral_map' WHEN 1 THEN 'revenue_records' WHEN 2 THEN 'building_footprint' WHEN 3 THEN 'gnss_cors' WHEN 4 THEN 'ground_truthing' WHEN 5 THEN 'municipal_gis' WHEN 6 THEN 'utility_network' WHEN 7 THEN 'ortho_ori' ELSE 'dsm_dtm' END AS category_id,
 CASE WHEN s_suppkey % 10 IN (1, 3, 4) THEN 'table' WHEN s_suppkey % 10 >= 7 THEN 'raster' ELSE 'vector' END AS kind, CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE CAST(FLOOR(s_acctbal / 10) AS BIGINT) END AS record_count, s_suppkey % 13 <> 5 AS parse_ok,
 CASE s_suppkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'inferred' ELSE 'resolved' END AS crs_status, s_suppkey % 4 AS invalid, s_suppkey % 3 AS nulls, s_suppkey % 7 <> 2 AS has_bounds, (s_suppkey % 11) / 10.0 AS fill, s_suppkey % 12 AS duplicates, s_nationkey AS version FROM supplier""",
    # Owners in two scripts.
    "v_local": "SELECT * FROM (VALUES (0, 'रमेश कुलकर्णी'), (1, 'सुरेश पाटील'), (2, 'राजेंद्र शिंदे'), (3, 'अनिता देशमुख'), (4, 'विजय जाधव'), (5, 'मीना जोशी'), (6, 'संजय पवार'), (7, 'गणेश मोरे')) AS t(k, local_name)",
    "v_english": "SELECT * FROM (VALUES (0, 'Ramesh Kulkarni'), (1, 'Suresh Patil'), (2, 'Rajendra Shinde'), (3, 'Anita Deshmukh'), (4, 'Vijay Jadhav'), (5, 'Mina Joshi'), (6, 'Sanjay Pawar'), (7, 'Ganesh More'), (8, 'Rajendra S. Shinde')) AS t(k, english_name)",
    "v_owner": """SELECT c.c_custkey AS idx, CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE l.local_name END AS local_a, CASE WHEN c.c_custkey % 31 = 0 THEN '' ELSE e.english_name END AS english_a,
 CASE WHEN c.c_custkey % 3 = 0 THEN m.local_name ELSE NULL END AS local_b, f.english_name AS english_b
 FROM customer c JOIN v_local l ON l.k = c.c_custkey % 8 JOIN v_english e ON e.k = CASE WHEN c.c_custkey % 4 = 1 THEN c.c_nationkey % 9 ELSE c.c_custkey % 8 END
 JOIN v_local m ON m.k = c.c_nationkey % 8 JOIN v_english f ON f.k = CASE WHEN c.c_custkey % 7 = 2 THEN c.c_nationkey % 9 ELSE c.c_custkey % 9 % 8 END""",
    # Files that arrive: one a supplier, of many formats, some of no category, some with a declared or written reference system.
    "v_file": """SELECT s_suppkey AS seq, concat('in/layer_', CAST(s_suppkey AS STRING), CASE s_suppkey % 11 WHEN 0 THEN '.geojson' WHEN 1 THEN '.CSV' WHEN 2 THEN '.tif' WHEN 3 THEN '.las' WHEN 4 THEN '.laz' WHEN 5 THEN '.gpkg' WHEN 6 THEN '.shp' WHEN 7 THEN '.dxf' WHEN 8 THEN '.pdf' WHEN 9 THEN '.tsv' ELSE '' END) AS filename,
 CASE s_suppkey % 5 WHEN 0 THEN 'cadastral_map' WHEN 1 THEN 'revenue_records' WHEN 2 THEN 'gnss_cors' WHEN 3 THEN 'dsm_dtm' ELSE 'holiday_photos' END AS category_id, CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 1000 ELSE s_suppkey * 7919 END AS BIGINT) AS size_bytes, s_suppkey % 13 <> 5 AS parse_ok,
 CAST(s_suppkey % 400 AS BIGINT) AS features, CASE WHEN s_suppkey % 4 = 0 THEN 32643 WHEN s_suppkey % 9 = 1 THEN 4326 END AS header_crs, CASE s_suppkey % 7 WHEN 2 THEN 32644 WHEN 4 THEN 99999 WHEN 5 THEN 7755 END AS declared_crs, CAST(CASE s_suppkey % 6 WHEN 1 THEN 73.9 WHEN 2 THEN 380000.5 WHEN 3 THEN 120.0 END AS DOUBLE) AS reach FROM supplier""",
    # A ring of 32 points a vector.
    "v_vector": "SELECT vec_id, embedding FROM embeddings",
}

#: Columns that are doubles: both engines read literals with a point as decimals, whose arithmetic differs.
DOUBLES = {
    "v_parcel": ("idx, parcel_id, khasra_no, owner_name, land_use, ward, balance", ("x0", "y0", "x1", "y1")),
    "v_register_all": ("reg_idx, parcel_ref, survey_no, state, price", ("recorded",)),
    "v_candidate": ("cand_idx, cand_id", ("x0", "y0", "x1", "y1")),
    "v_structure": ("b_idx, building_id, hint", ("x0", "y0", "x1", "y1")),
    "v_corridor": ("c_idx, corridor_id, conflict_type", ("buffer_m", "x0", "y0", "x1", "y1")),
    "v_survey": ("obs_idx, parcel, corner, accuracy, source", ("x", "y")),
}
for _name, (_rest, _cols) in DOUBLES.items():
    VIEWS[_name] = f"SELECT {_rest}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _cols)} FROM ({VIEWS[_name]}) q"


def _needs(name: str) -> list[str]:
    out: list[str] = []
    for other, text in VIEWS.items():
        if other != name and other in VIEWS[name].replace("(", " ").replace(")", " ").split():
            out += [x for x in [*_needs(other), other] if x not in out]
    return out


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of driver tables."""
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or one of VIEWS as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    order = [*_needs(name), name]
    words = set(" ".join(VIEWS[v] for v in order).replace("(", " ").replace(")", " ").split())
    tables(spark, sf_dir, *[t for t in TABLES if t in words])
    for v in order:
        out = spark.sql(VIEWS[v])
        out.createOrReplaceTempView(v)
    return out


def with_views(text: str) -> str:
    """Oracle SQL preceded by the relations that it names."""
    order: list[str] = []
    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
    for v in VIEWS:
        if v in words:
            order += [x for x in [*_needs(v), v] if x not in order]
    if not order:
        return text
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    return f"WITH {ctes}, {text.strip()[5:]}" if text.strip().upper().startswith("WITH ") else f"WITH {ctes} {text}"
