"""Export: features of one layer to a file format, and which formats there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from landloom.sources import formats

#: Formats that clients ask for, and why some are refused.
FORMATS = (("geojson", True, None), ("csv", True, None), ("gpkg", True, None), ("shp", True, None), ("pdf", True, None), ("kml", False, "no writer is bundled"), ("dxf", False, "no writer is bundled"))


class Refused(ValueError):
    """The format is unknown or has no writer."""


def available(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, ok, why) for f, ok, why in FORMATS], "format string, implemented boolean, reason string")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with header; each begins with a byte order mark, which spreadsheet programs look for."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_geojson(df: DataFrame, rings: str, properties: Sequence[str], path: str) -> None:
    """A feature a line, written where the rows are."""
    formats.geojson_lines(df, rings, *properties).write.mode("overwrite").text(path)


def text_pdf(lines: Sequence[str]) -> bytes:
    """A one-column report of text lines, 50 a page."""
    pages = [lines[i : i + 50] for i in range(0, max(len(lines), 1), 50)]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, page in enumerate(pages):
        safe = [x.encode("latin-1", "replace").decode("latin-1").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") for x in page]
        body = "BT /F1 10 Tf 14 TL 50 790 Td " + " ".join(f"({x}) Tj T*" for x in safe) + " ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>", f"<< /Length {len(body)} >>\nstream\n{body}\nendstream"]
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects):
        at.append(len(out))
        out += f"{i + 1} 0 obj\n{o}\nendobj\n".encode("latin-1")
    table = "".join(f"{a:010d} 00000 n \n" for a in at)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode("latin-1")


def report_lines(parcel: dict, lineage: Sequence[dict], conflicts: Sequence[dict]) -> list[str]:
    """Identity, lineage and at most twelve conflicts of one parcel; details are cut to 60 characters, as the page is."""
    return [f"{k}: {v}" for k, v in parcel.items()] + [""] + [f"{x['field']} = {x['value']} ({x['source']})" for x in lineage] + [""] + [f"{x['conflict_type']} {x['severity']} {x.get('detail', '')[:60]}" for x in list(conflicts)[:12]]


def export(df: DataFrame, kind: str, path: str, rings: str = "rings", layer: str = "parcels", srid: int = 32643) -> None:
    """Writes a layer; gpkg and shp make one file, so their rows must fit the driver, which those formats ask for anyway."""
    known = {f: (ok, why) for f, ok, why in FORMATS}
    if kind not in known or not known[kind][0] or kind == "pdf":
        raise Refused(f"{kind}: {known.get(kind, (0, 'unknown format'))[1] or 'reports are made of one parcel'}")
    properties = [c for c in df.columns if c != rings]
    if kind == "csv":
        return write_csv(df.select(properties), path)
    if kind == "geojson":
        return write_geojson(df, rings, properties, path)
    import numpy as np

    rows = [({p: r[p] for p in properties}, [np.array([(q["x"], q["y"]) for q in ring]) for ring in r[rings]]) for r in df.toLocalIterator()]
    raw = formats.write_gpkg(rows, layer, srid) if kind == "gpkg" else formats.write_shapefile(rows, ("parcel_id", "ulpin", "khasra_no", "owner_name", "land_use"))
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(raw))
    out.close()


