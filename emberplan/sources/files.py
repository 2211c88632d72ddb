"""Files as tables: uploads with a size cap, drawing exchange files, JSON in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import file_route

# Codes of $INSUNITS.
UNITS = {0: "unspecified", 1: "inches", 2: "feet", 4: "mm", 5: "cm", 6: "m"}
ENTITIES = "id long, kind string, layer string, text string, closed boolean, points array<struct<x:double,y:double>>, units string"


def uploads(spark: SparkSession, path: str, most_bytes: int = 20 << 20) -> DataFrame:
    """(path, length, route, accepted, content) of the files of a folder; too large ones keep
    their row and lose their content. Spark skips reading what the length filter drops."""
    f = spark.read.format("binaryFile").load(path)
    ok = F.col("length") <= most_bytes
    small = f.where(ok).select("path", "length", "content", F.lit(True).alias("accepted"))
    large = f.where(~ok).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(False).alias("accepted"))
    out = small.unionByName(large)
    magic = F.decode(F.substring("content", 1, 8), "ISO-8859-1")
    return out.select("path", "length", file_route(F.substring_index("path", "/", -1), F.coalesce(magic, F.lit(""))).alias("route"), "accepted", "content")


def _pairs(text: str):
    lines = text.splitlines()
    for code, value in zip(lines[::2], lines[1::2]):
        try:
            yield int(code), value.strip()
        except ValueError:
            return


def parse_dxf(text: str) -> list[dict]:
    """Entities of an ASCII drawing exchange file: texts, polylines, dimensions.

    Group codes: 0 starts an entity, 8 is its layer, 1 and 3 its text, 10 and 20 a point's x and
    y, 70 bit 1 closes a polyline. VERTEX entities belong to the POLYLINE before them.
    """
    out, entity, section, header, units = [], None, None, None, "unspecified"
    for code, value in _pairs(text or ""):
        if code == 2 and section == "":
            section = value
        elif code == 9:
            header = value
        elif code == 70 and header == "$INSUNITS" and section == "HEADER":
            units, header = UNITS.get(int(value), "unknown"), None
        elif code == 0:
            section = "" if value == "SECTION" else None if value == "ENDSEC" else section
            if section == "ENTITIES" and value not in ("VERTEX", "SEQEND"):
                entity = {"kind": value, "layer": "0", "text": "", "closed": False, "points": []}
                out.append(entity)
        elif entity is not None and section == "ENTITIES":
            if code == 8:
                entity["layer"] = value
            elif code in (1, 3):
                entity["text"] += value
            elif code == 10:
                entity["points"].append({"x": float(value), "y": 0.0})
            elif code == 20 and entity["points"]:
                entity["points"][-1]["y"] = float(value)
            elif code == 70 and entity["kind"] in ("LWPOLYLINE", "POLYLINE"):
                entity["closed"] |= bool(int(value) & 1)
    for e in out:
        if e["kind"] == "POLYLINE" and e["points"][:1] == [{"x": 0.0, "y": 0.0}] and len(e["points"]) > 1:
            e["points"] = e["points"][1:]  # the heading's own place is no vertex
    wanted = ("TEXT", "MTEXT", "LWPOLYLINE", "POLYLINE", "DIMENSION")
    return [e | {"units": units} for e in out if e["kind"] in wanted]


def dxf_entities(files: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """files (id, content string) to ENTITIES rows, of the given layers only if any are given."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [{"id": i, **e} for i, t in zip(pdf.id, pdf.content, strict=True) for e in parse_dxf(t)]
            yield pd.DataFrame(rows, columns=["id", "kind", "layer", "text", "closed", "points", "units"])

    out = files.select("id", "content").mapInPandas(run, ENTITIES)
    return out.where(F.col("layer").isin(layers)) if layers else out
