"""The harmonization run: sources to scored parcels, conflicts and lineage, and its tables.

The matches and the scored parcels are written once, as several tables read them; the rest is lazy, and persist() writes
each table once, by run. A run with a blocked dataset stops first, with the list of them (a catalogue has one row a source file).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import geom as G
from landloom.functions.num import rnd
from landloom.operators import attributes as A
from landloom.operators import matching as M
from landloom.operators import quality as Q
from landloom.operators import serving as V
from landloom.operators import spatial as S
from landloom.operators.cut import cut

#: Default parameters of a run.
DEFAULTS = {"match_iou": 0.55, "area_tolerance_pct": 3.5, "shift_m": 0.5, "area_change_pct": 2.0, "cell_m": 32.0}
TABLES = ("parcels", "conflicts", "parcel_attributes", "confidence_scores", "harmonization_runs", "audit_logs")


class Blocked(RuntimeError):
    """A dataset failed the quality gate."""


@dataclass
class Layers:
    """Sources: parcels (idx, parcel_id, khasra_no, owner_name, land_use, surveyed, box; owner_local, the name in the local script, if there is one),
    register (parcel_ref, reg_idx, recorded, survey_no, owner; owner_local likewise), candidates (cand_idx, cand_id, box), survey (obs_idx, x, y), structures (b_idx, hint, box), corridors (corridor_id,
    conflict_type, box), datasets (see quality.gate)."""

    parcels: DataFrame
    register: DataFrame
    candidates: DataFrame
    survey: DataFrame
    structures: DataFrame
    corridors: DataFrame
    datasets: DataFrame | None = None


def boxes(df: DataFrame, p: str, *cols: str) -> DataFrame:
    return S.prefixed(df.select(*cols, "x0", "y0", "x1", "y1"), p)


def run(layers: Layers, run_id: str, params: dict | None = None, strict: bool = True) -> dict[str, DataFrame]:
    """Tables of one run, by name."""
    p = DEFAULTS | (params or {})
    if layers.datasets is not None and strict:
        bad = [r["id"] for r in Q.gate(layers.datasets).filter("verdict = 'BLOCKED'").select("id").limit(20).collect()]
        if bad:
            raise Blocked(f"blocked datasets: {', '.join(bad)}")
    cell = p["cell_m"]
    local = lambda df, of: F.col(f"{of}owner_local") if "owner_local" in df.columns else F.lit(None).cast("string")
    centre = layers.candidates.select(F.col("cand_idx").alias("a_id"), ((F.col("x0") + F.col("x1")) / 2).alias("a_x"), ((F.col("y0") + F.col("y1")) / 2).alias("a_y"))
    near = S.nearest(centre, layers.survey.select(F.col("obs_idx").alias("b_order"), F.col("x").alias("b_x"), F.col("y").alias("b_y")), 16.0).select(F.col("a_id").alias("cand_idx"), rnd(F.col("distance"), 3).alias("distance"))
    right = layers.candidates.join(near, "cand_idx", "left").select(F.col("cand_idx").alias("b_order"), F.col("cand_id").alias("b_id"), F.col("distance").alias("b_distance"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    matched = M.assign_once(M.best_matches(boxes(layers.parcels, "a_", "idx"), right, size=cell), "b_id", "a_idx")
    matched = cut(matched.select(F.col("a_idx").alias("idx"), F.col("b_id").alias("cand_id"), "score", F.col("verdict").alias("match_verdict"), "iou", "outline", "shift", "likeness", F.col("b_distance").alias("distance")))
    looked = A.register_lookup(layers.parcels, layers.register, ["parcel_ref", "survey_no"], "idx", "khasra_no", "reg_idx")
    checks = looked.withColumn("area", A.area_check(F.col("register.recorded"), F.col("surveyed"), p["area_tolerance_pct"])).withColumn("owner", A.owner_check(local(layers.parcels, ""), F.col("owner_name"), local(layers.register, "register."), F.col("register.owner")))
    checks = checks.withColumn("attribute_status", A.overall(F.col("owner.status"), F.col("area.status"))).withColumn("attribute_score", A.attribute_score(F.col("owner.confidence"), F.col("area.status"), F.col("area.difference_pct")))
    disputes = S.grid_join(boxes(layers.parcels, "a_", "idx"), boxes(layers.parcels, "b_", "idx"), cell, lambda a, b: (F.col("a_idx") < F.col("b_idx")) & (G.box_overlap(a, b) > 0.05))
    issues = disputes.select(F.explode(F.array("a_idx", "b_idx")).alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("issues"))
    wide = checks.join(matched, "idx", "left").join(issues, "idx", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    signals = [F.col("iou"), F.col("outline"), F.col("attribute_score"), F.col("register.recorded"), F.col("surveyed"), F.col("issues"), F.col("distance")]
    passed, concerns = A.evidence(*signals)
    scored = cut(wide.withColumn("c", A.confidence(*signals)).withColumn("passed", passed).withColumn("concerns", concerns))  # five tables read it
    status = F.when(F.col("issues") > 0, "TOPOLOGY_ISSUE").otherwise(F.col("c.route"))
    parcels = scored.select(
        F.lit(run_id).alias("run_id"), "idx", "parcel_id", status.alias("status"), F.col("c.overall").alias("confidence"), F.col("c.route").alias("review_state"), "khasra_no", "owner_name", F.col("register.recorded").alias("recorded_area_sqm"),
        F.col("surveyed").alias("surveyed_area_sqm"), "land_use", "match_verdict", F.col("score").alias("match_score"), "attribute_status", "concerns",
    )
    scores = scored.select(F.lit(run_id).alias("run_id"), "parcel_id", F.col("c").alias("components"), "passed", "concerns", A.explanation(F.col("c.overall"), F.col("passed"), F.col("concerns")).alias("explanation"))
    moved, delta = M.shifted(F.col("shift"), F.col("likeness"), p["shift_m"], p["area_change_pct"])
    common = G.box_overlap(G.box("a_"), G.box("b_"))
    linear = S.grid_join(boxes(layers.parcels, "a_", "parcel_id"), boxes(layers.corridors, "b_", "conflict_type"), cell, lambda a, b: G.box_overlap(a, b) > 0).select(F.col("a_parcel_id").alias("parcel_id"), F.col("b_conflict_type").alias("conflict_type"), M.encroachment(common, G.box_area(G.box("a_"))).alias("e")).select("parcel_id", "conflict_type", "e.severity", "e.confidence")
    build = boxes(layers.structures, "a_", "b_idx", "hint").join(boxes(layers.parcels, "b_", "idx", "parcel_id"), F.col("a_hint") == F.col("b_idx")).select(F.col("b_parcel_id").alias("parcel_id"), M.building_relation(common, G.box_area(G.box("a_"))).alias("r")).filter("r.relation = 'CROSSES_BOUNDARY'").select("parcel_id", F.lit("building_vs_parcel").alias("conflict_type"), F.lit("MEDIUM").alias("severity"), F.col("r.coverage").alias("confidence"))
    attr = scored.filter("attribute_status = 'CONFLICT'").select("parcel_id", F.lit("attribute_conflict").alias("conflict_type"), F.lit("MEDIUM").alias("severity"), F.col("attribute_score").alias("confidence"))
    edge = scored.filter(moved & F.col("cand_id").isNotNull()).select("parcel_id", F.lit("boundary_divergence").alias("conflict_type"), F.when(delta > 10, "HIGH").otherwise("MEDIUM").alias("severity"), F.col("iou").alias("confidence"))
    conflicts = linear.unionByName(build).unionByName(attr).unionByName(edge).withColumn("status", F.lit("OPEN")).withColumn("run_id", F.lit(run_id))
    fields = V.lineage(scored.withColumn("recorded_area", F.col("register.recorded")), "parcel_id", {"khasra_no": "revenue_records", "owner_name": "revenue_records", "land_use": "revenue_records", "recorded_area": "revenue_records", "surveyed": "cadastral_map"}).withColumn("run_id", F.lit(run_id))
    summary = A.distribution(parcels, "confidence", "review_state").select(F.lit(run_id).alias("run_id"), F.lit("COMPLETED").alias("status"), F.current_timestamp().alias("finished_at"), F.to_json(F.struct("*")).alias("summary"))
    audit = layers.parcels.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit("system").alias("actor"), F.lit("harmonization.run").alias("action"), F.lit("COMPLETED").alias("result"), F.current_timestamp().alias("created_at"))
    return {"parcels": parcels, "conflicts": conflicts, "parcel_attributes": fields, "confidence_scores": scores, "harmonization_runs": summary, "audit_logs": audit}


def persist(tables: dict[str, DataFrame], store: str) -> None:
    """Writes each table of a run to the store, partitioned by run; a run written again replaces its own partitions only."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{store}/{name}")


def table(spark: SparkSession, store: str, name: str, run_id: str | None = None) -> DataFrame:
    """A stored table, or one run of it: the filter prunes partitions. Columns added later are null in older runs."""
    df = spark.read.option("mergeSchema", True).parquet(f"{store}/{name}")
    return df.filter(F.col("run_id") == run_id) if run_id else df


def latest_run(spark: SparkSession, store: str) -> str | None:
    row = table(spark, store, "harmonization_runs").agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("r")).first()
    return row["r"] if row else None
