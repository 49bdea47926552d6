"""Readers and writers of geographic files, over binary contents that Spark reads: any store, no local paths.

Readers take a DataFrame of (path, content) as spark.read.format("binaryFile") gives it and return rows of
features (path, fid, properties, rings or lines) or of headers; writers turn a bounded set of features into the
bytes of one file. GeoJSON is read and written by Spark's own JSON functions.
"""

from __future__ import annotations

import io
import json
import os
import sqlite3
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<array<array<double>>>"
FEATURES = f"path string, fid long, properties string, rings {POINTS}, srid int"


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of polygon layers: fid (place in its file), properties (map), kind, rings."""
    kind = "type string, features array<struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
    docs = files(spark, path).select("path", F.from_json(F.decode("content", "UTF-8"), kind).alias("d"))
    f = docs.select("path", F.posexplode("d.features").alias("fid", "f")).select("path", F.col("fid").cast("long"), F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    one = F.when(F.col("kind") == "Polygon", F.from_json("c", POINTS)).when(F.col("kind") == "MultiPolygon", F.flatten(F.from_json("c", f"array<{POINTS}>")))
    return f.select("path", "fid", "properties", "kind", one.alias("rings"))


def geojson_lines(df: DataFrame, rings: str, *properties: str) -> DataFrame:
    """One Feature a row as JSON text; rings are closed. Large layers are written so, a feature a line."""
    closed = F.transform(rings, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def wkb_polygon(rings: Iterable[np.ndarray]) -> bytes:
    """A polygon of closed rings, little-endian."""
    rings = [np.vstack([r, r[:1]]) for r in rings]
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in rings)


def from_wkb(raw: bytes) -> list[list[list[float]]]:
    """Rings of a polygon or multipolygon."""

    def one(at: int) -> tuple[list, int]:
        e = "<" if raw[at] else ">"
        kind, n = struct.unpack_from(f"{e}II", raw, at + 1)
        at += 9
        out = []
        for _ in range(n):
            if kind == 6:
                own, at = one(at)
                out += own
            else:
                (k,) = struct.unpack_from(f"{e}I", raw, at)
                pts = np.frombuffer(raw, f"{e}f8", 2 * k, at + 4).reshape(-1, 2)
                out.append(pts.tolist())
                at += 4 + 16 * k
        return out, at

    return one(0)[0]


def write_gpkg(rows: list[tuple[dict, list[np.ndarray]]], layer: str, srid: int) -> bytes:
    """A GeoPackage with one polygon layer; rows are (properties, rings). Empty layers are refused."""
    if not rows:
        raise ValueError("a layer without features can't be written")
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "x.gpkg")
        db = sqlite3.connect(path)
        names = list(rows[0][0])
        db.executescript(
            f"""PRAGMA application_id = {0x47504B47}; PRAGMA user_version = 10300;
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);
            CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB, {', '.join(f'"{n}" TEXT' for n in names)});"""
        )
        pts = np.vstack([r for _, rings in rows for r in rings])
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srid}", srid, srid))
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', '2024-01-01T00:00:00Z', ?, ?, ?, ?, ?)", (layer, layer, *pts.min(0).tolist(), *pts.max(0).tolist(), srid))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srid))
        head = b"GP\x00\x01" + struct.pack("<i", srid)
        db.executemany(f'INSERT INTO "{layer}" VALUES ({", ".join("?" * (len(names) + 2))})', [(i + 1, head + wkb_polygon(rings), *[None if p[n] is None else str(p[n]) for n in names]) for i, (p, rings) in enumerate(rows)])
        db.commit()
        db.close()
        with open(path, "rb") as f:
            return f.read()


def read_gpkg(contents: DataFrame) -> DataFrame:
    """Features of all layers of GeoPackages: FEATURES."""

    def run(batches):
        for part in batches:
            out = []
            for path, raw in zip(part["path"], part["content"], strict=True):
                with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
                    f.write(raw)
                    f.flush()
                    db = sqlite3.connect(f.name)
                    for layer, geom, srid in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchall():
                        cursor = db.execute(f'SELECT * FROM "{layer}" ORDER BY 1')
                        names = [c[0] for c in cursor.description]
                        for row in cursor:
                            v = dict(zip(names, row, strict=True))
                            blob = v.pop(geom)
                            fid = v.pop(names[0])
                            skip = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] if blob else 0
                            out.append((path, fid, json.dumps(v, ensure_ascii=False), from_wkb(blob[skip:]) if blob else None, srid))
                    db.close()
            yield pd.DataFrame(out, columns=["path", "fid", "properties", "rings", "srid"])

    return contents.mapInPandas(run, FEATURES)


def write_shapefile(rows: list[tuple[dict, list[np.ndarray]]], identity: tuple[str, ...] = ()) -> bytes:
    """A zipped polygon shapefile (.shp, .shx, .dbf, .prj); more than ten columns are cut to the identity columns and others up to nine."""
    if not rows:
        raise ValueError("a layer without features can't be written")
    names = list(rows[0][0])
    if len(names) > 10:
        names = ([n for n in names if n in identity] + [n for n in names if n not in identity])[:9]
    pts = np.vstack([r for _, rings in rows for r in rings])
    shp, shx, at = [], [], 50
    for i, (_, rings) in enumerate(rows):
        closed = [np.vstack([r, r[:1]])[::-1] for r in rings]  # outer rings run clockwise
        own = np.vstack(closed)
        starts = np.cumsum([0, *map(len, closed[:-1])])
        body = struct.pack("<i4d2i", 5, *own.min(0), *own.max(0), len(closed), len(own)) + starts.astype("<i4").tobytes() + own.astype("<f8").tobytes()
        shp.append(struct.pack(">2i", i + 1, len(body) // 2) + body)
        shx.append(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 5, *pts.min(0), *pts.max(0), 0, 0, 0, 0)
    texts = [[("" if p[n] is None else str(p[n])).encode()[:254] for n in names] for p, _ in rows]
    width = [max(1, *(len(t[k]) for t in texts)) for k in range(len(names))]
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(names), 1 + sum(width))
    dbf += b"".join(struct.pack("<11sc4xB15x", n.encode()[:10], b"C", w) for n, w in zip(names, width, strict=True)) + b"\r"
    dbf += b"".join(b" " + b"".join(v.ljust(w) for v, w in zip(t, width, strict=True)) for t in texts) + b"\x1a"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("layer.shp", head(at) + b"".join(shp))
        z.writestr("layer.shx", head(50 + 4 * len(rows)) + b"".join(shx))
        z.writestr("layer.dbf", dbf)
        z.writestr("layer.prj", "")
    return out.getvalue()


def read_shapefile(contents: DataFrame) -> DataFrame:
    """Features of zipped polygon shapefiles: FEATURES."""

    def run(batches):
        for part in batches:
            out = []
            for path, raw in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    name = {n.rsplit(".", 1)[-1].lower(): n for n in z.namelist()}
                    shp, dbf = z.read(name["shp"]), z.read(name["dbf"])
                n, size, width = struct.unpack_from("<IHH", dbf, 4)
                fields = []
                for k in range(32, size - 1, 32):
                    fields.append((dbf[k : k + 11].split(b"\0")[0].decode(), dbf[k + 16]))
                at = 100
                for i in range(n):
                    words = struct.unpack_from(">i", shp, at + 4)[0]
                    body = shp[at + 8 : at + 8 + 2 * words]
                    at += 8 + 2 * words
                    rings = None
                    if struct.unpack_from("<i", body)[0] in (5, 15, 25):
                        parts, points = struct.unpack_from("<2i", body, 36)
                        cut = [*struct.unpack_from(f"<{parts}i", body, 44), points]
                        xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
                        rings = [xy[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)]
                    where, v = size + i * width + 1, {}
                    for f, w in fields:
                        v[f] = dbf[where : where + w].decode("utf-8", "replace").strip() or None
                        where += w
                    out.append((path, i, json.dumps(v, ensure_ascii=False), rings, None))
            yield pd.DataFrame(out, columns=["path", "fid", "properties", "rings", "srid"]).astype({"srid": "Int32"})

    return contents.mapInPandas(run, FEATURES)


def write_tiff(band: np.ndarray, origin: tuple[float, float], pixel: float, nodata: float | None = None, epsg: int = 32643) -> bytes:
    """A single-band GeoTIFF, deflated strips."""
    rows, cols = band.shape
    data = zlib.compress(np.ascontiguousarray(band).astype(band.dtype.newbyteorder("<")).tobytes())
    kind = {"u": 1, "i": 2, "f": 3}[band.dtype.kind]
    geo = struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)
    tags: list[tuple[int, int, int, bytes]] = [
        (256, 4, 1, struct.pack("<I", cols)), (257, 4, 1, struct.pack("<I", rows)), (258, 3, 1, struct.pack("<H", band.dtype.itemsize * 8)), (259, 3, 1, struct.pack("<H", 8)), (262, 3, 1, struct.pack("<H", 1)), (273, 4, 1, b"DATA"),
        (277, 3, 1, struct.pack("<H", 1)), (278, 4, 1, struct.pack("<I", rows)), (279, 4, 1, struct.pack("<I", len(data))), (339, 3, 1, struct.pack("<H", kind)),
        (33550, 12, 3, struct.pack("<3d", pixel, pixel, 0)), (33922, 12, 6, struct.pack("<6d", 0, 0, 0, *origin, 0)), (34735, 3, 16, geo),
    ]
    if nodata is not None:
        text = f"{nodata:g}\0".encode()
        tags.append((42113, 2, len(text), text))
    start = 8
    ifd, extra = 2 + 12 * len(tags) + 4, b""
    out = struct.pack("<H", len(tags))
    ends = start + ifd
    data_at = ends + sum(len(v) + len(v) % 2 for *_, v in tags if len(v) > 4)
    for tag, k, n, v in tags:
        v = struct.pack("<I", data_at) if v == b"DATA" else v
        if len(v) <= 4:
            out += struct.pack("<HHI", tag, k, n) + v.ljust(4, b"\0")
        else:
            out += struct.pack("<HHII", tag, k, n, ends + len(extra))
            extra += v + b"\0" * (len(v) % 2)
    return b"II*\0" + struct.pack("<I", start) + out + b"\0\0\0\0" + extra + data


def parse_tiff(raw: bytes) -> tuple[dict, np.ndarray]:
    """Header and pixels (bands, rows, columns) of a striped TIFF, plain or deflated."""
    e = "<" if raw[:2] == b"II" else ">"
    size = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d"}
    (at,) = struct.unpack_from(f"{e}I", raw, 4)
    (n,) = struct.unpack_from(f"{e}H", raw, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{e}HHI", raw, at + 2 + 12 * i)
        if kind in size:
            f = f"{count}s" if kind == 2 else f"{count}{size[kind]}"
            long = struct.calcsize(e + f) > 4
            where = struct.unpack_from(f"{e}I", raw, at + 10 + 12 * i)[0] if long else at + 10 + 12 * i
            tags[tag] = struct.unpack_from(e + f, raw, where)
    get = lambda t, d: tags.get(t, (d,))[0]
    cols, rows, bands = get(256, 0), get(257, 0), get(277, 1)
    dtype = np.dtype(f"{e}{ {1: 'u', 2: 'i', 3: 'f'}[get(339, 1)] }{get(258, 8) // 8}")
    parts = [raw[o : o + k] for o, k in zip(tags[273], tags[279], strict=True)]
    if get(259, 1) in (8, 32946):
        parts = [zlib.decompress(p) for p in parts]
    elif get(259, 1) != 1:
        raise ValueError("this compression has no reader here")
    cells = np.frombuffer(b"".join(parts), dtype, rows * cols * bands).reshape(rows, cols, bands).transpose(2, 0, 1)
    scale, tie = tags.get(33550), tags.get(33922)
    nodata = float(tags[42113][0].split(b"\0")[0]) if 42113 in tags else None
    keys = tags.get(34735, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (3072, 2048)), None)
    return {"width": cols, "height": rows, "bands": bands, "pixel": scale[0] if scale else None, "x": tie[3] if tie else None, "y": tie[4] if tie else None, "nodata": nodata, "epsg": epsg}, cells


def raster_stats(contents: DataFrame) -> DataFrame:
    """For the first three bands of each raster: size, pixel, system, least, largest and mean (4 places) of the cells that aren't masked."""

    def run(batches):
        for part in batches:
            out = []
            for path, raw in zip(part["path"], part["content"], strict=True):
                head, cells = parse_tiff(raw)
                for b, own in enumerate(cells[:3], 1):
                    v = own[own != head["nodata"]] if head["nodata"] is not None else own.ravel()
                    out.append((path, b, head["width"], head["height"], head["pixel"], head["epsg"], *((float(v.min()), float(v.max()), round(float(v.mean(dtype=float)), 4)) if v.size else (None, None, None))))
            yield pd.DataFrame(out, columns=["path", "band", "width", "height", "pixel", "epsg", "least", "largest", "mean"])

    return contents.mapInPandas(run, "path string, band int, width int, height int, pixel double, epsg int, least double, largest double, mean double")


def las_headers(contents: DataFrame) -> DataFrame:
    """Version, point format, count, scale and offset of LAS files from their first 227 bytes; ok tells whether the signature is right."""

    def run(batches):
        for part in batches:
            out = []
            for path, raw in zip(part["path"], part["content"], strict=True):
                if raw[:4] != b"LASF" or len(raw) < 227:
                    out.append((path, False, None, None, None, None))
                    continue
                old, = struct.unpack_from("<I", raw, 107)
                count = struct.unpack_from("<Q", raw, 247)[0] if raw[24:26] >= b"\x01\x04" and len(raw) >= 255 else old
                out.append((path, True, f"{raw[24]}.{raw[25]}", raw[104] & 0x3F, count, list(struct.unpack_from("<6d", raw, 131))))
            yield pd.DataFrame(out, columns=["path", "ok", "version", "point_format", "points", "scale_offset"]).astype({"point_format": "Int32", "points": "Int64"})

    return contents.mapInPandas(run, "path string, ok boolean, version string, point_format int, points long, scale_offset array<double>")
