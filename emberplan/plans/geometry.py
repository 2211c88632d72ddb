"""Queries over points, polygons, pixels and graphs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as ge
from ..operators import graph as gr
from ..sources.binding import FLOORS, floors, table
from .buildings import s
from .registry import query

# A building's floors as points of a page: fifty parts are a page, so pages grow in number, not in size.
POINTS = "pts AS (SELECT part // 50 AS grp, building_id * 100 + floor_idx AS id, CAST(part * 7 % 997 AS DOUBLE) AS x, CAST((part * 13 + supplier * 31 + floor_idx * 57) % 991 AS DOUBLE) AS y FROM floors)"
LABELS = "lbs AS (SELECT p_partkey // 50 AS grp, p_partkey AS jd, CAST(p_partkey * 17 % 997 AS DOUBLE) AS bx, CAST(p_size * 19 AS DOUBLE) AS by, p_brand AS text FROM part)"


def points(spark, d):
    p, u, k = F.col("part"), F.col("supplier"), F.col("floor_idx")
    return floors(spark, d).select(F.expr("part div 50").alias("grp"), (F.col("building_id") * 100 + k).alias("id"), (p * 7 % 997).cast("double").alias("x"), ((p * 13 + u * 31 + k * 57) % 991).cast("double").alias("y"))


def labels(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.expr("p_partkey div 50").alias("grp"), k.alias("jd"), (k * 17 % 997).cast("double").alias("bx"), (F.col("p_size") * 19).cast("double").alias("by"), F.col("p_brand").alias("text"))


DIST = "sqrt(pow(p.x - l.bx, 2) + pow(p.y - l.by, 2))"


@query(s(FLOORS, "v AS (SELECT building_id, floor_idx, CAST(part % 97 AS DOUBLE) AS x, CAST(supplier % 89 + floor_idx * 3 AS DOUBLE) AS y FROM floors)", "n AS (SELECT *, lead(x, 1) OVER w AS x2, lead(y, 1) OVER w AS y2, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM v WINDOW w AS (PARTITION BY building_id ORDER BY floor_idx))", "SELECT building_id, count(*) AS points, CASE WHEN count(*) >= 3 THEN abs(sum(x * coalesce(y2, fy) - coalesce(x2, fx) * y)) / 2 ELSE 0 END AS area FROM n GROUP BY building_id"))
def w4_shoelace(spark, d):
    """Polygon areas from each vertex and its cyclic next."""
    p = F.struct("floor_idx", (F.col("part") % 97).cast("double").alias("x"), (F.col("supplier") % 89 + F.col("floor_idx") * 3).cast("double").alias("y"))
    x = floors(spark, d).groupBy("building_id").agg(F.array_sort(F.collect_list(p)).alias("p"))
    return x.select("building_id", F.size("p").cast("long").alias("points"), ge.shoelace("p").alias("area"))


@query(s(FLOORS, "a AS (SELECT building_id % 500 AS doc, building_id AS shape, sum(area) * CASE WHEN count(*) >= 3 THEN 1 ELSE 0 END AS area FROM floors WHERE building_id % 3 > 0 GROUP BY ALL)", "b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY area DESC, shape) AS rank FROM a WHERE area > 0)", "SELECT doc, shape, area, CAST(rank AS INTEGER) AS rank FROM b WHERE rank <= 5 AND area > 10"))
def t1_top5(spark, d):
    """The five largest closed polygons of a document, then those large enough."""
    agg = floors(spark, d).groupBy("building_id").agg(F.sum("area").alias("a"), F.count("*").alias("n"))
    # A rectangle of that area, or a line where there are fewer than three floors.
    pt = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), y.cast("double").alias("y"))
    box = F.array(pt(0.0, F.lit(0.0)), pt(1.0, F.lit(0.0)), pt(1.0, F.col("a")), pt(0.0, F.col("a")))
    x = agg.select((F.col("building_id") % 500).alias("doc"), F.col("building_id").alias("shape"), F.when(F.col("n") >= 3, box).otherwise(F.slice(box, 1, 2)).alias("points"), (F.col("building_id") % 3 > 0).alias("closed"))
    return ge.top_areas(x, "doc")


@query(s(FLOORS, POINTS, LABELS, f"j AS (SELECT p.grp, p.id, l.text, {DIST} AS dist, row_number() OVER (PARTITION BY p.grp, p.id ORDER BY {DIST}, l.jd) AS r FROM pts p JOIN lbs l ON l.grp = p.grp WHERE {DIST} < 200)", "SELECT p.grp, p.id, coalesce(j.text, 'Unlabelled') AS text, j.dist FROM pts p LEFT JOIN j ON j.grp = p.grp AND j.id = p.id AND j.r = 1"))
def j13_nearest(spark, d):
    """The nearest label within a radius, by grid cells."""
    return ge.nearest(points(spark, d), labels(spark, d), 200.0, "Unlabelled")


@query(s(FLOORS, POINTS, LABELS, f"SELECT p.grp, p.id, min({DIST}) AS dist FROM pts p JOIN lbs l ON l.grp = p.grp GROUP BY ALL"))
def j14_nearest_distance(spark, d):
    """The distance to the nearest point of another set, however far."""
    return ge.nearest_distance(points(spark, d), labels(spark, d).drop("text"), 150.0)


@query(s(FLOORS, POINTS, LABELS, f"m AS (SELECT p.grp, min({DIST}) AS dist FROM pts p JOIN lbs l ON l.grp = p.grp GROUP BY p.grp, p.id)", "SELECT grp, count(*) AS points, avg(dist) AS mean_dist FROM m GROUP BY grp"))
def a24_validation_means(spark, d):
    """Mean nearest distance of a page."""
    return ge.nearest_distance(points(spark, d), labels(spark, d).drop("text"), 150.0).groupBy("grp").agg(F.count("*").alias("points"), F.avg("dist").alias("mean_dist"))


@query(s(FLOORS, POINTS, LABELS, f"m AS (SELECT p.grp, min({DIST}) AS dist FROM pts p JOIN lbs l ON l.grp = p.grp GROUP BY p.grp, p.id)", f"b AS (SELECT l.grp, min({DIST}) AS dist FROM lbs l JOIN pts p ON l.grp = p.grp GROUP BY l.grp, l.jd)", "x AS (SELECT grp, count(*) AS points, avg(dist) AS there FROM m GROUP BY grp)", "y AS (SELECT grp, count(*) AS labels, avg(dist) AS back FROM b GROUP BY grp)", "SELECT x.grp, x.points, y.labels, x.there, y.back FROM x JOIN y USING (grp)"))
def a24_validation_report(spark, d):
    """Mean nearest distances of a page in both directions."""
    p, l = points(spark, d), labels(spark, d).drop("text")
    turned = l.select("grp", F.col("jd").alias("id"), F.col("bx").alias("x"), F.col("by").alias("y"))
    to = p.select("grp", F.col("id").alias("jd"), F.col("x").alias("bx"), F.col("y").alias("by"))
    there = ge.nearest_distance(p, l, 150.0).groupBy("grp").agg(F.count("*").alias("points"), F.avg("dist").alias("there"))
    back = ge.nearest_distance(turned, to, 150.0).groupBy("grp").agg(F.count("*").alias("labels"), F.avg("dist").alias("back"))
    return there.join(back, "grp")


@query(s(FLOORS, POINTS, LABELS, f"j AS (SELECT p.grp, p.id, l.bx, l.by, row_number() OVER (PARTITION BY p.grp, p.id ORDER BY l.jd) AS r FROM pts p JOIN lbs l ON l.grp = p.grp WHERE {DIST} <= 60)", "SELECT p.grp, p.id, coalesce((p.x + j.bx) / 2, p.x) AS px, coalesce((p.y + j.by) / 2, p.y) AS py FROM pts p LEFT JOIN j ON j.grp = p.grp AND j.id = p.id AND j.r = 1"))
def j15_pair_points(spark, d):
    """The midpoint with the first point within a radius, or the point itself."""
    return ge.pair_points(points(spark, d), labels(spark, d).drop("text"), 60.0)


@query(s(FLOORS, POINTS, "bx AS (SELECT s_suppkey // 2 AS grp, CAST(s_suppkey * 11 % 700 AS DOUBLE) AS tx0, CAST(s_suppkey * 7 % 700 AS DOUBLE) AS ttop FROM supplier)", "SELECT p.id, EXISTS (SELECT 1 FROM bx b WHERE b.grp = p.grp AND p.x + 10 BETWEEN b.tx0 AND b.tx0 + 300 AND p.y + 5 BETWEEN b.ttop AND b.ttop + 300) AS in_table FROM pts p"))
def j16_in_box(spark, d):
    """Lines whose centre lies in one of their page's tables."""
    p = points(spark, d).select("grp", "id", F.col("x").alias("x0"), (F.col("x") + 20).alias("x1"), F.col("y").alias("top"), (F.col("y") + 10).alias("bottom"))
    k = F.col("s_suppkey")
    b = table(spark, d, "supplier").select(F.expr("s_suppkey div 2").alias("grp"), (k * 11 % 700).cast("double").alias("tx0"), (k * 7 % 700).cast("double").alias("ttop"))
    b = b.withColumn("tx1", F.col("tx0") + 300).withColumn("tbottom", F.col("ttop") + 300)
    return ge.in_boxes(p, b, "grp").select("id", "in_table")


@query(s("sp AS (SELECT l_orderkey AS k, l_partkey % 500 AS start, l_partkey % 500 + CAST(l_quantity AS BIGINT) AS stop, l_linenumber AS n FROM lineitem)", 'SELECT a.k, a.start, a.stop AS "end" FROM sp a WHERE a.n > 2 AND NOT EXISTS (SELECT 1 FROM sp b WHERE b.k = a.k AND b.n <= 2 AND a.start < b.stop AND b.start < a.stop)'))
def j17_overlap_anti(spark, d):
    """Spans that overlap no span of a higher priority."""
    start = F.col("l_partkey") % 500
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), "l_linenumber")
    return ge.unclaimed(x.where("l_linenumber > 2").drop("l_linenumber"), x.where("l_linenumber <= 2").drop("l_linenumber"), "k")


@query(s("v AS (SELECT l_suppkey AS page, 10 + l_quantity / 10 + CASE WHEN l_partkey % 9 = 0 THEN 40 ELSE 0 END AS v FROM lineitem)", "m AS (SELECT page, median(v) AS m FROM v GROUP BY page)", "k AS (SELECT v.page, v, v BETWEEN m / CAST(1.2 AS DOUBLE) AND m * CAST(1.2 AS DOUBLE) AS ok FROM v JOIN m USING (page))", "x AS (SELECT page, avg(v) FILTER (ok) AS mean, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS rejected, (max(v) FILTER (ok) - min(v) FILTER (ok)) / avg(v) FILTER (ok) AS spread FROM k GROUP BY page)", "SELECT *, CASE WHEN kept >= 3 AND spread < 0.15 THEN 'green' WHEN kept >= 1 THEN 'amber' ELSE 'red' END AS confidence FROM x"))
def a16_robust_mean(spark, d):
    """Means without outliers of the median."""
    v = 10 + F.col("l_quantity") / 10 + F.when(F.col("l_partkey") % 9 == 0, 40).otherwise(0)
    return ge.robust_mean(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), v.alias("v")), "page", "v")


RECTS = "shp AS (SELECT p_partkey AS page, p_size % 20 + 2 AS x0, p_partkey % 17 + 3 AS y0, p_size % 20 + 12 AS x1, p_partkey % 17 + 11 AS y1, p_partkey % 3 = 0 AS line FROM part)"


def shapes(spark, d):
    k, z = F.col("p_partkey").cast("int"), F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.when(k % 3 == 0, "line").otherwise("rect").alias("kind"), (z % 20 + 2).alias("x0"), (k % 17 + 3).alias("y0"), (z % 20 + 12).alias("x1"), F.when(k % 3 == 0, k % 17 + 3).otherwise(k % 17 + 11).alias("y1"))


PIXELS = "px AS (SELECT DISTINCT page, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM shp, unnest(range(y0, y1 + 1)) AS a(r), unnest(range(x0, x1 + 1)) AS b(c) WHERE CASE WHEN line THEN r = y0 ELSE r IN (y0, y1) OR c IN (x0, x1) END)"


@query(s(RECTS, PIXELS, "SELECT page, row, col FROM px"))
def g2_raster(spark, d):
    """Lines and the sides of rectangles as pixels (also G1)."""
    return ge.rasterise(ge.wall_segments(shapes(spark, d)))


@query(s(RECTS, PIXELS, "c AS (SELECT page, x0 + 5 AS pc, y0 + 4 AS pr FROM shp WHERE NOT line)", "SELECT c.page, CAST(min(CASE WHEN px.row = pr AND col > pc THEN col - pc END) + min(CASE WHEN px.row = pr AND col < pc THEN pc - col END) AS INTEGER) AS w, CAST(min(CASE WHEN col = pc AND px.row > pr THEN px.row - pr END) + min(CASE WHEN col = pc AND px.row < pr THEN pr - px.row END) AS INTEGER) AS h FROM c JOIN px USING (page) GROUP BY c.page"))
def g9_rays(spark, d):
    """Room extents from the nearest walls in four directions."""
    x = shapes(spark, d).where("kind = 'rect'")
    walls = ge.rasterise(ge.wall_segments(x))
    p = x.select("page", F.lit(0).alias("id"), (F.col("y0") + 4).alias("row"), (F.col("x0") + 5).alias("col"))
    return ge.cast_rays(p, walls, 60, 60).select("page", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))


@query(s(RECTS, "c AS (SELECT page, 2500 + p AS a, 2000 + p AS b, p FROM (SELECT page, page % 50 AS p FROM shp WHERE NOT line))", "SELECT page, ((a / 10.0::DOUBLE) + (b / 8.0::DOUBLE)) / 2 AS mm_per_pt FROM c"))
def g10_scale(spark, d):
    """Millimetres for each point from printed and measured room extents."""
    rays = g9_rays(spark, d)
    a, b = 2500 + F.col("page") % 50, 2000 + F.col("page") % 50
    hi, lo = F.greatest("w", "h"), F.least("w", "h")
    return rays.where((hi > 0) & (lo > 0)).select("page", ((F.greatest(a, b) / hi + F.least(a, b) / lo) / 2).alias("mm_per_pt"))


@query("SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 2 AS x_pt, 800 - CAST(p_partkey % 97 AS DOUBLE) / 2 AS y_pt, p_size AS back_col, CAST(p_partkey % 97 AS INTEGER) AS back_row FROM part")
def g13_coordinates(spark, d):
    """Raster places to page points and back."""
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97).alias("row"), F.col("p_size").alias("col"))
    return x.select("id", *ge.to_points("row", "col", 2.0, 800.0))


@query(s(RECTS, "SELECT page, CAST(16 AS BIGINT) + 20 AS size, CAST(y0 AS BIGINT) AS r0, CAST(x0 AS BIGINT) AS c0, CAST(y1 AS BIGINT) AS r1, CAST(x1 AS BIGINT) AS c1 FROM shp WHERE NOT line"))
def g4_components(spark, d):
    """Eight-connected regions off the border, large enough, with sizes and boxes."""
    px = ge.rasterise(ge.wall_segments(shapes(spark, d).where("kind = 'rect'")))
    return gr.regions(px, 60, 60, 20).select("page", "size", "r0", "c0", "r1", "c1")


# Each order's lines are the nodes of a small graph, one edge from each to an earlier one.
EDGES = "ed AS (SELECT building_id AS grp, floor_idx AS dst, (part + supplier) % floor_idx AS src, CAST(supplier % 7 + 1 AS DOUBLE) AS length FROM floors WHERE floor_idx > 0)"


def graph_edges(spark, d):
    k = F.col("floor_idx")
    return floors(spark, d).where("floor_idx > 0").select(F.col("building_id").alias("grp"), ((F.col("part") + F.col("supplier")) % k).cast("long").alias("src"), k.cast("long").alias("dst"), (F.col("supplier") % 7 + 1).cast("double").alias("length"))


@query(s(FLOORS, EDGES, "x AS (SELECT grp, src AS node FROM ed UNION ALL SELECT grp, dst FROM ed)", "g AS (SELECT grp, node, count(*) AS degree FROM x GROUP BY ALL)", "SELECT grp, count(*) AS nodes, count(*) FILTER (degree >= 3) AS junctions, count(*) FILTER (degree = 1) AS leaves FROM g GROUP BY grp"))
def g8_junctions(spark, d):
    """Nodes, junctions and leaves of each graph."""
    g = gr.degrees(graph_edges(spark, d))
    return g.groupBy("grp").agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") >= 3).alias("junctions"), F.count_if(F.col("degree") == 1).alias("leaves"))


@query(s(FLOORS, EDGES, "b AS (SELECT grp, src, dst, length FROM ed UNION ALL SELECT grp, dst, src, length FROM ed)", "ndx AS (SELECT DISTINCT grp, src AS n FROM b)", "r AS (SELECT grp, n AS src, n AS dst, CAST(0 AS DOUBLE) AS dist FROM ndx UNION SELECT r.grp, r.src, b.dst, r.dist + b.length FROM r JOIN b ON b.grp = r.grp AND b.src = r.dst WHERE r.dist + b.length <= 12)", "SELECT grp, src, dst, min(dist) AS dist FROM r GROUP BY ALL").replace("WITH ", "WITH RECURSIVE ", 1))
def g11_paths(spark, d):
    """Shortest paths between all nodes of each small graph, up to a length."""
    return gr.shortest_paths(graph_edges(spark, d), 12.0)


@query()
def g7_walkable(spark, d):
    """Pruned and contracted graphs."""
    return gr.walkable(graph_edges(spark, d), 3.0)


@query()
def g12_cover(spark, d):
    """Greedy places so that every node is within a radius."""
    return gr.cover(graph_edges(spark, d), 6.0)


@query()
def g3_opening(spark, d):
    """Opened and thinned pixels of filled rooms."""
    x = shapes(spark, d).where("kind = 'rect'").select("page", F.explode(F.sequence("y0", "y1")).alias("row"), "x0", "x1").select("page", F.col("row").cast("int").alias("row"), F.explode(F.sequence("x0", "x1")).alias("col")).withColumn("col", F.col("col").cast("int"))
    return gr.opened(x, 2).withColumn("what", F.lit("opened")).unionByName(gr.thinned(x).withColumn("what", F.lit("thinned")))


@query()
def a23_clusters(spark, d):
    """Points in order, each to the first cluster whose seed is near."""
    p = points(spark, d).select("grp", F.col("id").alias("ordinal"), "x", "y")
    return ge.clusters(p, "grp", 120.0)


@query("SELECT page, n % 3 = 0 AS labelled, CASE WHEN n % 3 = 0 THEN 'TERRACE' END AS floor_label FROM (SELECT p_partkey AS page, p_size AS n FROM part)")
def g15_page_floors(spark, d):
    """Pages with their floor label; pages without one stay."""
    from ..operators.pages import largest_label

    p = table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.col("p_size").alias("n"))
    words = p.where("n % 3 = 0").select("page", F.explode(F.array(F.struct(F.lit(0).alias("ordinal"), F.lit("F 1").alias("label"), F.lit(8.0).alias("size")), F.struct(F.lit(1).alias("ordinal"), F.lit("TERRACE").alias("label"), F.lit(14.0).alias("size")), F.struct(F.lit(2).alias("ordinal"), F.lit("GF").alias("label"), F.lit(14.0).alias("size")))).alias("w")).select("page", "w.*")
    lab = largest_label(words)
    return p.join(lab, "page", "left").select("page", F.col("label").isNotNull().alias("labelled"), F.col("label").alias("floor_label"))
