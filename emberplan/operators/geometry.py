"""Polygons, points, boxes, spans and scales as joins and folds.

Point joins go by grid cells as wide as the radius: a point meets the 3 x 3 cells around its own,
so the join has an equality to hash by and is never all against all.

Spark's estimate of a table's size does not see that rows are exploded, so a side of points around
or of pixels must never be broadcast by it: it is the outer side, or the join is a merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shoelace(points) -> Column:
    """Area of ARRAY<STRUCT<x, y>>, 0 below three points."""
    points = F.col(points) if isinstance(points, str) else points
    n = F.size(points)
    turned = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    parts = F.zip_with(points, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(n >= 3, F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(0.0)


def top_areas(shapes: DataFrame, key: str, k: int = 5, least: float = 10.0) -> DataFrame:
    """shapes (key, shape, points, closed): the k largest closed ones of a key, then those above least."""
    x = shapes.where("closed").withColumn("area", shoelace("points")).where("area > 0")
    w = Window.partitionBy(key).orderBy(F.desc("area"), "shape")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col("area") > least).select(key, "shape", "area", "rank")


def near_pairs(a: DataFrame, b: DataFrame, radius: float, strict: bool = True) -> DataFrame:
    """a (grp, id, x, y) with b (grp, jd, bx, by) of its group within radius: adds dist, which is
    null in rows of a that met none there. The exploded side is the outer one, so only b can be
    broadcast; for that, callers aggregate without a filter on dist."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.withColumn("_cx", cell("x")).withColumn("_cy", cell("y")).withColumn("_o", F.explode(around))
    left = left.withColumn("_kx", F.col("_cx") + F.col("_o.i")).withColumn("_ky", F.col("_cy") + F.col("_o.j"))
    right = b.withColumnRenamed("grp", "_g").withColumn("_bx", cell("bx")).withColumn("_by", cell("by"))
    j = left.join(right, (F.col("grp") == F.col("_g")) & (F.col("_kx") == F.col("_bx")) & (F.col("_ky") == F.col("_by")), "left")
    dist = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    j = j.withColumn("dist", F.when(dist < radius if strict else dist <= radius, dist))
    return j.select(*a.columns, *[c for c in b.columns if c != "grp"], "dist")


def _met(*columns: str) -> Column:
    return F.when(F.col("dist").isNotNull(), F.struct(*columns))


def nearest(a: DataFrame, b: DataFrame, radius: float, default: str) -> DataFrame:
    """(grp, id, text, dist) of each point of a: the nearest b's text within radius, ties to the
    least jd, else the default. b has grp, jd, bx, by, text."""
    best = near_pairs(a, b, radius).groupBy("grp", "id").agg(F.min(_met("dist", "jd", "text")).alias("m"))
    return a.select("grp", "id").join(best, ["grp", "id"], "left").select("grp", "id", F.coalesce("m.text", F.lit(default)).alias("text"), F.col("m.dist").alias("dist"))


def nearest_distance(a: DataFrame, b: DataFrame, cell: float = 100.0) -> DataFrame:
    """(grp, id, dist) to the nearest point of b in the group, however far; infinite without one.

    Cells are tried first; only points with no neighbour there are compared with their whole
    group, whose points of b are summed into one list of a bounded page.
    """
    near = near_pairs(a, b, cell, strict=False).groupBy("grp", "id").agg(F.min("dist").alias("dist"))
    out = a.join(near, ["grp", "id"], "left")
    far = out.where("dist is null").drop("dist")
    lists = b.groupBy(F.col("grp").alias("_g")).agg(F.collect_list(F.struct("bx", "by")).alias("points"))
    d = F.array_min(F.transform("points", lambda p: F.hypot(F.col("x") - p["bx"], F.col("y") - p["by"])))
    far = far.join(lists, F.col("grp") == F.col("_g"), "left").select("grp", "id", F.coalesce(d, F.lit(float("inf"))).alias("dist"))
    return out.where("dist is not null").select("grp", "id", "dist").unionByName(far)


def pair_points(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(grp, id, px, py): a point with the first (least jd) of b within radius, their midpoint,
    or the point itself."""
    first = near_pairs(a, b, radius, strict=False).groupBy("grp", "id").agg(F.min(_met("jd", "bx", "by")).alias("m"))
    j = a.join(first, ["grp", "id"], "left")
    return j.select("grp", "id", F.coalesce((F.col("x") + F.col("m.bx")) / 2, F.col("x")).alias("px"), F.coalesce((F.col("y") + F.col("m.by")) / 2, F.col("y")).alias("py"))


def in_boxes(lines: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Adds in_table: whether a line's centre lies in one of its page's boxes. A page has few boxes."""
    lists = boxes.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("tx0", "ttop", "tx1", "tbottom")).alias("boxes"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    hit = F.exists("boxes", lambda b: cx.between(b["tx0"], b["tx1"]) & cy.between(b["ttop"], b["tbottom"]))
    return lines.join(lists, F.col(key) == F.col("_k"), "left").withColumn("in_table", F.coalesce(hit, F.lit(False))).drop("_k", "boxes")


def unclaimed(spans: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    """Spans (key, start, end) that overlap none of their key's claimed ones: an interval anti-join."""
    c = claimed.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(c, (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")


def robust_mean(samples: DataFrame, key: str, value: str, ratio: float = 1.2) -> DataFrame:
    """(key, mean, kept, rejected, spread, confidence) of values within ratio of their median."""
    m = samples.groupBy(key).agg(F.median(value).alias("_m"))
    j = samples.join(m, key).withColumn("_ok", F.col(value).between(F.col("_m") / ratio, F.col("_m") * ratio))
    v = F.when(F.col("_ok"), F.col(value))
    agg = j.groupBy(key).agg(F.avg(v).alias("mean"), F.count(v).alias("kept"), (F.count("*") - F.count(v)).alias("rejected"), ((F.max(v) - F.min(v)) / F.avg(v)).alias("spread"))
    return agg.withColumn("confidence", F.when((F.col("kept") >= 3) & (F.col("spread") < 0.15), "green").when(F.col("kept") >= 1, "amber").otherwise("red"))


def wall_segments(shapes: DataFrame) -> DataFrame:
    """shapes (page, kind, x0, y0, x1, y1): lines as they are, rectangles as their four sides."""
    seg = lambda a, b, c, d: F.struct(F.col(a).alias("ax"), F.col(b).alias("ay"), F.col(c).alias("bx"), F.col(d).alias("by"))
    sides = F.array(seg("x0", "y0", "x1", "y0"), seg("x1", "y0", "x1", "y1"), seg("x1", "y1", "x0", "y1"), seg("x0", "y1", "x0", "y0"))
    return shapes.select("page", F.inline(F.when(F.col("kind") == "rect", sides).otherwise(F.array(seg("x0", "y0", "x1", "y1")))))


def rasterise(segments: DataFrame) -> DataFrame:
    """(page, row, col) of the pixels along integer segments, each once."""
    steps = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))).cast("int")
    t = segments.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = lambda a, b: F.when(F.col("_n") == 0, F.col(a)).otherwise(F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("_i") / F.nullif(F.col("_n"), F.lit(0)) + 0.5)).cast("int")
    return t.select("page", at("ay", "by").alias("row"), at("ax", "bx").alias("col")).distinct()


def cast_rays(points: DataFrame, walls: DataFrame, width: int, height: int) -> DataFrame:
    """(page, id, w, h): room extents at points (page, id, row, col) from the nearest wall pixels
    in four directions; the border counts as a wall. Two equality joins, by row and by column, as
    merge joins: pixels are many more than Spark estimates."""
    r = walls.select(F.col("page").alias("_p"), F.col("row").alias("_r"), F.col("col").alias("_c")).hint("merge")
    gap = lambda cond, d: F.min(F.when(cond, d))
    across = points.join(r, (F.col("page") == F.col("_p")) & (F.col("row") == F.col("_r")), "left").groupBy("page", "id", "row", "col").agg(
        F.coalesce(gap(F.col("_c") < F.col("col"), F.col("col") - F.col("_c")), F.first("col")).alias("left"), F.coalesce(gap(F.col("_c") > F.col("col"), F.col("_c") - F.col("col")), width - 1 - F.first("col")).alias("right")
    )
    down = across.join(r, (F.col("page") == F.col("_p")) & (F.col("col") == F.col("_c")), "left").groupBy("page", "id", "row", "col", "left", "right").agg(
        F.coalesce(gap(F.col("_r") < F.col("row"), F.col("row") - F.col("_r")), F.first("row")).alias("up"), F.coalesce(gap(F.col("_r") > F.col("row"), F.col("_r") - F.col("row")), height - 1 - F.first("row")).alias("down")
    )
    return down.select("page", "id", (F.col("left") + F.col("right")).alias("w"), (F.col("up") + F.col("down")).alias("h"))


def to_points(row: str, col: str, scale: float, height: float) -> list[Column]:
    """Raster place to page points (y grows upwards there) and back."""
    x, y = F.col(col) / scale, height - F.col(row) / scale
    return [x.alias("x_pt"), y.alias("y_pt"), F.floor(x * scale + 0.5).cast("int").alias("back_col"), F.floor((height - y) * scale + 0.5).cast("int").alias("back_row")]


def clusters(points: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, cluster, x, y, n): points in order join the first cluster whose seed is within radius.

    Each point depends on those before it, so a page's points are one list, folded in Python;
    a batch holds many pages.
    """
    lists = points.groupBy(F.col(key).cast("long").alias(key)).agg(F.array_sort(F.collect_list(F.struct("ordinal", "x", "y"))).alias("p"))

    def fold(batches):
        import math

        import pyarrow as pa

        for b in batches:
            rows = []
            for page, pts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found: list[list] = []  # seed x, seed y, sum x, sum y, n
                for p in pts:
                    near = next((c for c in found if math.hypot(c[0] - p["x"], c[1] - p["y"]) <= radius), None)
                    if near is None:
                        found.append([p["x"], p["y"], p["x"], p["y"], 1])
                    else:
                        near[2] += p["x"]
                        near[3] += p["y"]
                        near[4] += 1
                rows += [(page, i, c[2] / c[4], c[3] / c[4], c[4]) for i, c in enumerate(found)]
            types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[key, "cluster", "x", "y", "n"])

    return lists.mapInArrow(fold, f"{key} long, cluster int, x double, y double, n int")
