"""Mapping of source headers to the canonical schema, and how well layers fill it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.functions import text as T
from landloom.functions.num import coerce_number, rnd

#: Canonical fields and the headers that stand for them, in order of precedence.
ALIASES = {
    "parcel_id": ("parcel_id", "parcelid", "parcel id", "unique id", "object id", "shape id", "feature_id", "id", "parcel_id_hint", "parcel hint", "parcel no", "parcel number", "cadastral id", "lp no", "lp_no"),
    "ulpin": ("ulpin", "ulpin_code", "land id", "bhu aadhaar", "bhu_aadhaar", "parcel ulpin", "luin", "uid"),
    "khasra_no": ("khasra_no", "khasra", "khasra number", "survey_no", "survey number", "plot_no", "plot number", "no", "s.no", "number", "tp no", "tp_no", "part no", "parcel_ref", "parcel reference", "survey_ref", "survey number (old)", "old survey no"),
    "owner_name": ("owner_name", "owner", "owner_en", "owner name", "name of owner", "recorded holder", "holder name", "bhogtidar", "recorded name"),
    "owner_name_local": ("owner_name_local", "owner_vernacular", "owner_vernacular_hi", "owner_local", "local name", "name in local language", "owner name (local)", "marathi name", "holder local"),
    "property_type": ("property_type", "type", "usage type", "occupancy", "tenure", "ownership type"),
    "land_use": ("land_use", "landuse", "use", "use type", "zoning", "land classification", "usage"),
    "recorded_area_sqm": ("recorded_area_sqm", "recorded_area", "legal_area_sqm", "legal area", "area", "area_sqm", "ror area", "deed area", "documented area"),
    "surveyed_area_sqm": ("surveyed_area_sqm", "surveyed_area", "measured area", "actual area", "ground area"),
    "ward": ("ward", "ward_no", "ward number", "prabhag", "segment", "ward code"),
    "village": ("village", "village_name", "gaon", "locality", "town", "place", "mauza"),
    "zone": ("zone", "zone_name", "planning zone", "zone code", "fz", "use zone"),
    "road_ref": ("road_ref", "road", "road name", "street", "marg", "road reference"),
    "utility_ref": ("utility_ref", "utility", "line ref", "pipeline", "power line", "water line"),
}
NUMERIC = ("recorded_area_sqm", "surveyed_area_sqm")
REQUIRED = ("parcel_id", "ulpin", "khasra_no", "owner_name", "owner_name_local", "recorded_area_sqm", "surveyed_area_sqm")


def standardise(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Canonical columns (null where no header maps), with what is left in a map column, extra.

    Headers are looked at once, when the plan is built. Numbers are coerced, text is trimmed and empty
    text is null; columns named geometry... don't go to extra.
    """
    headers = [c for c in df.columns if c not in keep]
    found = T.first_headers(headers, ALIASES)
    cols = []
    for field in ALIASES:
        kind = "double" if field in NUMERIC else "string"
        raw = F.col(f"`{found[field]}`") if field in found else None
        value = F.lit(None).cast(kind) if raw is None else coerce_number(raw) if kind == "double" else F.nullif(F.trim(raw.cast("string")), F.lit(""))
        cols.append(value.alias(field))
    rest = [c for c in headers if c not in found.values() and not c.startswith("geometry")]
    extra = F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(f"`{c}`").cast("string") for c in rest])) if rest else F.lit(None).cast("map<string,string>")
    return df.select(*keep, *cols, extra.alias("extra"))


def fill_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: the share of rows with a value, 4 places, for each column."""
    has = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull().cast("double")
    return df.agg(*[rnd(F.avg(has(c)), 4).alias(c) for c in cols])


def never_filled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns that no row fills: field, filled (false)."""
    one = df.agg(*[F.coalesce(F.bool_or(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""), F.lit(False)).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in cols])).alias("x")).select("x.*").filter("NOT filled")


def compatibility(headers: Sequence[str]) -> tuple[int, float, str]:
    """How many of the canonical fields the headers cover, the share (4 places) and a verdict.

    Without any required field a layer is incompatible, with some of them partial; with all it is compatible if
    half of the others are there too, else usable.
    """
    found = T.first_headers(headers, ALIASES)
    missing = [f for f in REQUIRED if f not in found]
    optional = [f for f in ALIASES if f not in REQUIRED]
    score = int(len(found) / len(ALIASES) * 10000 + 0.5) / 10000
    if missing:
        verdict = "INCOMPATIBLE" if len(missing) == len(REQUIRED) else "PARTIAL"
    else:
        verdict = "COMPATIBLE" if sum(f in found for f in optional) * 2 >= len(optional) else "USABLE"
    return len(found), score, verdict
