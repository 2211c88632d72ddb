"""Queries over drawing text, pages, tables and merged sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import merge as mg
from ..operators import pages as pg
from ..sources.binding import DRAWINGS, drawings, table
from .buildings import s
from .registry import query


def q(p: str) -> str:
    """A pattern as a SQL literal that ignores case."""
    return "'(?i)" + p.replace("'", "''") + "'"


def _first(patterns, low, high, kind="DOUBLE", plus_one=None) -> str:
    tries = []
    for i, p in enumerate(patterns):
        v = f"TRY_CAST(nullif(regexp_extract(text, {q(p)}, 1), '') AS {kind})" + (" + 1" if i == plus_one else "")
        tries.append(f"CASE WHEN {v} BETWEEN {low} AND {high} THEN {v} END")
    return "coalesce(" + ", ".join(tries) + ")"


def _list(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


HEIGHT = _first(tx.HEIGHT, 2.0, 500.0)
STOREYS = _first(tx.STOREYS, 1, 200, "INTEGER", 2)


@query(s(DRAWINGS, f"SELECT doc_id, {HEIGHT} AS height FROM drawings"))
def x2_height(spark, d):
    """Three patterns; a value out of range lets the next try."""
    return drawings(spark, d).select("doc_id", tx.height("text").alias("height"))


@query(s(DRAWINGS, f"SELECT doc_id, {STOREYS} AS storeys FROM drawings"))
def x3_floors(spark, d):
    return drawings(spark, d).select("doc_id", tx.storeys("text").alias("storeys"))


AREAS = """ar AS (SELECT doc_id, text, regexp_replace(text, {0}, ' # ', 'g') AS t1 FROM drawings),
ar2 AS (SELECT *, regexp_replace(t1, {1}, ' # ', 'g') AS t2 FROM ar),
av AS (SELECT doc_id, 0 AS k, 'basement_area' AS label, unnest(regexp_extract_all(text, {0}, 1)) AS v FROM ar2
  UNION ALL SELECT doc_id, 1, 'floor_area', unnest(regexp_extract_all(t1, {1}, 1)) FROM ar2 UNION ALL SELECT doc_id, 2, 'generic_area', unnest(regexp_extract_all(t2, {2}, 1)) FROM ar2),
areas AS (SELECT doc_id, label, CAST(v AS DOUBLE) AS value FROM av WHERE CAST(v AS DOUBLE) BETWEEN 5 AND 100000)""".format(*[q(p) for _, p in tx.AREAS])


@query(s(DRAWINGS, AREAS, "SELECT doc_id, label, value FROM areas"))
def x4_areas(spark, d):
    """Areas by pattern; a number is never counted under two labels."""
    return drawings(spark, d).select("doc_id", F.inline(tx.areas("text")))


@query(s(DRAWINGS, f"n AS (SELECT doc_id, left(trim(coalesce(nullif(regexp_extract(text, {q(tx.PROJECT[0])}, 1), ''), nullif(regexp_extract(text, {q(tx.PROJECT[1])}, 1), '')), ' \t\n'), 100) AS project_name FROM drawings)", "SELECT * FROM n WHERE project_name IS NOT NULL"))
def x5_project_name(spark, d):
    return drawings(spark, d).select("doc_id", tx.project_name("text").alias("project_name")).where("project_name is not null")


OCR_TEXT = "'sheet ' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN ' CLIENT ' || upper(p_name) || ' PROJECT DWG NO' WHEN 1 THEN ' Building Name: ' || p_name || ' tower of stone' ELSE ' developer, owner from their duties' END"


@query(s(f"o AS (SELECT p_partkey AS doc_id, {OCR_TEXT} AS text FROM part)", f"w AS (SELECT doc_id, list_slice(string_split_regex(trim(regexp_extract(text, {q(tx.OCR_PROJECT)}, 1)), '\\s+'), 1, 8) AS w FROM o WHERE regexp_extract(text, {q(tx.OCR_PROJECT)}, 1) <> '')", f"p AS (SELECT doc_id, w, coalesce(list_min(list_filter(range(1, len(w) + 1), lambda i: list_contains({_list(tx.OCR_STOP)}, lower(trim(w[i], '.,:;-'))))), len(w) + 1) AS stop FROM w)", "r AS (SELECT doc_id, left(trim(array_to_string(list_slice(w, 1, stop - 1), ' '), ' .,:-'), 100) AS project_name FROM p)", "SELECT * FROM r WHERE length(project_name) >= 3"))
def x5_ocr_project_name(spark, d):
    """A name between a label and the next label-like word."""
    t = table(spark, d, "part").selectExpr("p_partkey AS doc_id", OCR_TEXT.replace("p_partkey ||", "cast(p_partkey as string) ||") + " AS text")
    return t.select("doc_id", tx.ocr_project_name("text").alias("project_name")).where("project_name is not null")


@query(s(DRAWINGS, f"SELECT doc_id, list_filter({_list(tx.CITIES)}, lambda x: contains(upper(text), upper(x)))[1] AS city, list_filter({_list(tx.STATES)}, lambda x: contains(upper(text), upper(x)))[1] AS state FROM drawings"))
def x6_city_state(spark, d):
    return drawings(spark, d).select("doc_id", tx.first_listed("text", tx.CITIES).alias("city"), tx.first_listed("text", tx.STATES).alias("state"))


def _hint(words, alias) -> str:
    return f"list_filter({_list([w for w, _ in words])}, lambda x: contains(lower(text), x))[1] AS {alias}"


@query(s(DRAWINGS, f"SELECT doc_id, {_hint(tx.OCCUPANCY, 'drawing_hint')}, {_hint(tx.DXF_OCCUPANCY, 'dxf_hint')}, {_hint(tx.FORM_OCCUPANCY, 'form_hint')} FROM drawings"))
def x7_keyword(spark, d):
    """First keyword of each of three maps, found within words too."""
    return drawings(spark, d).select("doc_id", *[tx.occupancy("text", m)["hint"].alias(n) for m, n in ((tx.OCCUPANCY, "drawing_hint"), (tx.DXF_OCCUPANCY, "dxf_hint"), (tx.FORM_OCCUPANCY, "form_hint"))])


CONSTRUCTION = f"CASE WHEN len(list_filter({_list(tx.FIRE_RESISTIVE)}, lambda x: contains(lower(text), x))) > 0 THEN 'type12' WHEN len(list_filter({_list(tx.WOOD)}, lambda x: contains(lower(text), x))) > 0 THEN 'type34' END"


@query(s(DRAWINGS, f"SELECT doc_id, {CONSTRUCTION} AS construction_type, CASE WHEN regexp_matches(text, '(?i)\\bkitchen\\b') THEN true END AS kitchen, CASE WHEN regexp_matches(text, '(?i)\\bsprinkler') THEN true END AS sprinklers FROM drawings"))
def x8_construction(spark, d):
    """Construction keywords in order, kitchen and sprinklers true or null."""
    return drawings(spark, d).select("doc_id", tx.construction("text").alias("construction_type"), tx.mentions("text", r"\bkitchen\b").alias("kitchen"), tx.mentions("text", r"\bsprinkler").alias("sprinklers"))


@query(s(DRAWINGS, f"SELECT doc_id, {_first(tx.BASEMENT_LEVELS, 1, 10, 'INTEGER')} AS levels, CAST(nullif(regexp_extract(text, {q(tx.AREAS[0][1])}, 1), '') AS DOUBLE) AS area FROM drawings"))
def x10_basement(spark, d):
    return drawings(spark, d).select("doc_id", tx.basement_levels("text").alias("levels"), tx.found("text", tx.AREAS[0][1]).cast("double").alias("area"))


def _labels(patterns) -> str:
    every = ", ".join(f"regexp_extract_all(text, {q(p)})" for p in patterns)
    return f"array_to_string(list_sort(list_distinct(list_transform(flatten([{every}]), lambda x: upper(regexp_replace(trim(x), '\\s+', ' ', 'g'))))), ',')"


@query(s(DRAWINGS, f"SELECT doc_id, {_labels(tx.FLOOR_LABELS)} AS floors, {_labels(tx.ROOM_LABELS)} AS rooms FROM drawings"))
def x11_labels(spark, d):
    """Floor and room labels, each once, sorted."""
    return drawings(spark, d).select("doc_id", F.concat_ws(",", tx.labels("text", tx.FLOOR_LABELS)).alias("floors"), F.concat_ws(",", tx.labels("text", tx.ROOM_LABELS)).alias("rooms"))


RATIOS = ", ".join(f"list_transform(regexp_extract_all(text, {q(p)}, 1), lambda x: replace(x, ' ', ''))" for p in tx.SCALES) + f", list_transform(list_filter(regexp_extract_all(text, {q(tx.SCALE_CM)}, 1), lambda v: CAST(v AS DOUBLE) > 0 AND CAST(v AS DOUBLE) < 1000), lambda v: '1:' || CAST(round_even(CAST(v AS DOUBLE) * 100, 0) AS BIGINT))"


@query(s(DRAWINGS, f"r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'unknown' END AS header, flatten([{RATIOS}]) AS all_r, lower(nullif(regexp_extract(text, {q(tx.UNITS)}, 1), '')) AS u FROM drawings)", "x AS (SELECT doc_id, all_r[1] AS value, CASE WHEN header = 'm' THEN 'm' END AS h, CASE WHEN u = 'mm' THEN 'mm' WHEN u IS NOT NULL THEN 'm' END AS said, len(list_distinct(all_r)) > 1 AS ambiguous FROM r)", "SELECT doc_id, value, coalesce(h, said) AS unit, CASE WHEN value IS NOT NULL OR h IS NOT NULL OR said IS NOT NULL THEN 'amber' ELSE 'red' END AS confidence, CASE WHEN value IS NOT NULL THEN 'title_block_text' WHEN h IS NOT NULL THEN 'dxf_header' WHEN said IS NOT NULL THEN 'title_block_text' ELSE 'not_detected' END AS source, ambiguous FROM x"))
def x12_scale(spark, d):
    """Scale ratios in order, units of a header or of the text."""
    x = drawings(spark, d).withColumn("header", F.when(F.col("doc_id") % 3 == 0, "m").when(F.col("doc_id") % 3 == 1, "unknown"))
    return x.select("doc_id", tx.scale("text", F.col("header")).alias("x")).select("doc_id", "x.*")


LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line_idx FROM drawings)"


def lines(spark, d):
    return drawings(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))


def _any(ps) -> str:
    return q("|".join(f"(?:{p})" for p in ps))


BLOCK = f"CASE WHEN trim(text, ' \t\n') = '' THEN 'UNKNOWN' WHEN regexp_matches(trim(text, ' \t\n'), {q(tx.NOTES_LINE)}) THEN 'NOTES' WHEN regexp_matches(text, {q(tx.KEY_PLAN)}) THEN 'KEY_PLAN' WHEN regexp_matches(text, {_any(tx.FLOOR_LABELS)}) THEN 'FLOOR_LABEL' WHEN regexp_matches(text, {_any(tx.ROOM_LABELS)}) THEN 'ROOM_LABEL' WHEN regexp_matches(trim(text, ' \t\n'), {q(tx.DIMENSION_LINE)}) THEN 'DIMENSION' ELSE 'UNKNOWN' END"
BOXED = "bx AS (SELECT doc_id, line_idx, text, CAST((doc_id * 37 + line_idx * 211) % 1000 AS DOUBLE) AS x0, CAST((doc_id * 53 + line_idx * 97) % 1000 AS DOUBLE) AS top FROM ln)"


def boxed(spark, d):
    x0 = ((F.col("doc_id") * 37 + F.col("line_idx") * 211) % 1000).cast("double")
    top = ((F.col("doc_id") * 53 + F.col("line_idx") * 97) % 1000).cast("double")
    return lines(spark, d).withColumn("x0", x0).withColumn("top", top)


@query(s(DRAWINGS, LINES, BOXED, f"SELECT doc_id, CAST(line_idx AS INTEGER) AS line_idx, CASE WHEN x0 > 650 OR top > 700 THEN 'TITLE_BLOCK' ELSE {BLOCK} END AS block FROM bx"))
def x13_block(spark, d):
    """Lines by place, then by words."""
    zone = tx.in_title_zone(F.col("x0"), F.col("top"), F.lit(1000.0), F.lit(1000.0))
    return boxed(spark, d).select("doc_id", "line_idx", F.when(zone, "TITLE_BLOCK").otherwise(tx.block_class(F.col("text"))).alias("block"))


DIMS = " UNION ALL ".join(f"SELECT doc_id, '{u}' AS unit, CAST(unnest(regexp_extract_all(text, {q(p)}, 1)) AS DOUBLE) * CAST({k} AS DOUBLE) AS value FROM drawings" for u, p, k in tx.DIMENSIONS)


@query(s(DRAWINGS, f"SELECT doc_id, unit, count(*) AS n, max(value) AS largest FROM ({DIMS}) GROUP BY ALL"))
def x1_dimensions(spark, d):
    return drawings(spark, d).select("doc_id", F.inline(tx.dimensions("text"))).groupBy("doc_id", "unit").agg(F.count("*").alias("n"), F.max("value").alias("largest"))


PAIRS = "p_partkey AS doc_id, 'ROOM ' || (p_size * 100 + 1000) || 'X' || (p_size * 70 + 900) || ' and ' || p_size || 'x' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ' HALL 3370 × 5170' ELSE '' END AS text"


@query(s(f"t AS (SELECT {PAIRS} FROM part)", f"SELECT doc_id, CAST(unnest(regexp_extract_all(text, '{tx.PAIR}', 1)) AS INTEGER) AS a, CAST(unnest(regexp_extract_all(text, '{tx.PAIR}', 2)) AS INTEGER) AS b FROM t"))
def x15_pairs(spark, d):
    """Printed widths and depths."""
    t = table(spark, d, "part").selectExpr(*[c + " AS " + a for c, a in (x.rsplit(" AS ", 1) for x in PAIRS.split(", ", 1))])
    t = t.select("doc_id", *[F.regexp_extract_all("text", F.lit(tx.PAIR), F.lit(i)).alias(n) for i, n in ((1, "as"), (2, "bs"))])
    return t.select("doc_id", F.inline(F.arrays_zip("as", "bs"))).select("doc_id", F.col("as").cast("int").alias("a"), F.col("bs").cast("int").alias("b"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, CASE event_id % 4 WHEN 0 THEN 'quota' WHEN 1 THEN 'model' WHEN 2 THEN 'timeout' ELSE 'other' END AS error FROM events")
def x16_json_replies(spark, d):
    """Fenced JSON parsed with a schema, errors sorted by their words."""
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```\n"), "props", F.lit("```"))).otherwise(F.col("props"))
    error = F.element_at(F.array(*[F.lit(x) for x in ("HTTP 429 Too many", "404 not found", "Timeout after 8 s", "refused")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", F.from_json(tx.unfenced(raw), "k LONG")["k"].alias("k"), tx.error_kind(error).alias("error"))


AREA_TABLES = """tabs AS (SELECT l_orderkey AS id, list([CASE WHEN l_linenumber = 1 THEN 'GROUND  FLOOR' WHEN l_linenumber = 2 THEN 'F 2' WHEN l_linenumber = 3 THEN '' ELSE 'TERRACE' END, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)] ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS r, any_value(l_orderkey % 2) AS k FROM lineitem GROUP BY l_orderkey)"""


def area_tables(spark, d):
    """A table of strings for each order: every second one is headed as a floor-area table."""
    line = table(spark, d, "lineitem")
    label = F.when(F.col("l_linenumber") == 1, "GROUND  FLOOR").when(F.col("l_linenumber") == 2, "F 2").when(F.col("l_linenumber") == 3, "").otherwise("TERRACE")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", F.array(label, F.col("l_quantity").cast("long").cast("string")).alias("r"))
    t = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("rows"))
    head = F.when(F.col("id") % 2 == 0, F.array(F.lit("FLOOR"), F.lit("AREA SQ.M"))).otherwise(F.array(F.lit("PLOT"), F.lit("AREA SQ.M")))
    return t.select("id", F.concat(F.array(head), "rows").alias("rows"))


@query(s(AREA_TABLES, "x AS (SELECT id, unnest(r) AS r FROM tabs WHERE k = 0)", "SELECT id, upper(regexp_replace(trim(r[1]), '\\s+', ' ', 'g')) AS label, CAST(r[2] AS DOUBLE) AS value FROM x WHERE r[1] <> '' AND CASE WHEN r[1] = 'F 2' THEN CAST(r[2] AS DOUBLE) >= 5 ELSE CAST(r[2] AS DOUBLE) BETWEEN 5 AND 100000 END"))
def x14_table_areas(spark, d):
    """Floor areas of the tables that are headed as such; the first number in range counts."""
    return area_tables(spark, d).select("id", F.inline(pg.floor_areas_of_table(F.col("rows"), tx.FLOOR_LABELS)))


@query(s("t AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (l_linenumber <= 2) AS cells_with FROM lineitem GROUP BY 1)", "SELECT id, CAST(n * 3 AS INTEGER) AS cells, CAST(cells_with AS DOUBLE) / (n * 3) AS fill_ratio, n * 3 BETWEEN 2 AND 2000 AND CAST(cells_with AS DOUBLE) / (n * 3) >= 0.35 AS passes FROM t"))
def a14_table_quality(spark, d):
    """Cells by the widest row and the share that holds something."""
    line = table(spark, d, "lineitem")
    row = F.array(F.when(F.col("l_linenumber") <= 2, "x").otherwise(" "), F.lit(""), F.lit(None).cast("string"))
    t = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(row).alias("rows"))
    cells, ratio = pg.table_figures(F.col("rows"))
    return t.select("id", cells.alias("cells"), ratio.alias("fill_ratio"), pg.table_passes(F.col("rows")).alias("passes"))


@query("SELECT n_nationkey AS id, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_name || '\\|x | ' || n_regionkey || ' |' || chr(10) || '| only |  |' AS md FROM nation")
def k4_markdown(spark, d):
    """Tables as Markdown, short rows filled, bars escaped."""
    rows = F.array(F.array(F.lit("name"), F.lit("key")), F.array(F.concat("n_name", F.lit("|x")), F.col("n_regionkey").cast("string")), F.array(F.lit("only")))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), pg.markdown(rows).alias("md"))


PAGES = "pgs AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 3 * 150 AS paths, doc_id % 2 AS images FROM documents)"
PAGE_CLASS = "pc AS (SELECT *, length(text) AS text_len, CASE WHEN length(text) > 0 THEN CAST(len(regexp_extract_all(text, '[\\x{FFFD}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) AS DOUBLE) / length(text) ELSE 0 END AS garbage_ratio FROM pgs), pcl AS (SELECT *, CASE WHEN text_len > 0 AND garbage_ratio > 0.15 THEN 'POOR_TEXT' WHEN text_len >= 10 THEN 'NATIVE_TEXT' WHEN paths >= 200 THEN 'MIXED' WHEN images > 0 THEN 'IMAGE_ONLY' ELSE 'SCANNED' END AS page_class FROM pc), pr AS (SELECT *, CASE page_class WHEN 'NATIVE_TEXT' THEN 'vector' WHEN 'MIXED' THEN 'mixed' WHEN 'POOR_TEXT' THEN 'mixed' ELSE 'scanned' END AS route FROM pcl)"


def classed(spark, d):
    k = F.col("doc_id")
    x = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (k % 3 * 150).alias("paths"), (k % 2).alias("images"))
    x = x.select("doc_id", "paths", "images", *pg.signals(F.col("text"), F.lit(1000.0), F.lit(800.0)))
    x = x.withColumn("page_class", pg.page_class(F.col("text_len"), F.col("garbage_ratio"), F.col("paths"), F.col("images")))
    return x.withColumn("route", pg.route(F.col("page_class")))


@query(s(PAGES, PAGE_CLASS, "SELECT doc_id, CAST(text_len AS INTEGER) AS text_len, garbage_ratio, text_len / 800000.0::DOUBLE * 1000 AS text_density, page_class, route FROM pr"))
def b1_page_class(spark, d):
    """Pages by their signals, and the route of each class."""
    return classed(spark, d).select("doc_id", "text_len", "garbage_ratio", "text_density", "page_class", "route")


@query(s(PAGES, PAGE_CLASS, "SELECT doc_id % 97 AS file, count(*) AS pages, CASE WHEN count(*) FILTER (route IN ('vector', 'mixed')) >= count(*) FILTER (route = 'scanned') THEN 'vector_pdf' ELSE 'scanned_pdf' END AS doc_type FROM pr GROUP BY 1"))
def a13_document_type(spark, d):
    """Majority of pages, ties to vector."""
    out = pg.document_type(classed(spark, d).select((F.col("doc_id") % 97).alias("doc_id"), "route"))
    return out.select(F.col("doc_id").alias("file"), "pages", "doc_type")


@query("SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'dwg' WHEN 2 THEN 'dxf' WHEN 3 THEN 'image' WHEN 4 THEN 'pdf' ELSE 'unsupported' END AS route FROM part")
def s6_file_route(spark, d):
    """Extension or magic bytes."""
    k = F.col("p_partkey") % 6
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k + 1).cast("int"))
    name = pick("plan.PDF", "a.dwg", "b.dxf", "c.JPEG", "noext", "d.txt")
    magic = pick("....", "AC10", "0   ", "....", "%PDF-1.7", "hello")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), pg.file_route(name, magic).alias("route"))


@query("SELECT doc_id % 40 AS doc_id, count(*) AS kept, CAST(min(page) AS INTEGER) AS first_page FROM (SELECT doc_id, doc_id // 40 AS page, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS r FROM documents WHERE doc_id % 2 = 0) WHERE r <= 5 GROUP BY 1")
def t2_page_cap(spark, d):
    """At most five pages of a document, after the subset asked for."""
    x = table(spark, d, "documents").where("doc_id % 2 = 0").select((F.col("doc_id") % 40).alias("doc"), F.expr("doc_id div 40").alias("page"), "doc_id")
    return pg.top_k(x, "doc", [F.col("doc_id")], 5).groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("kept"), F.min("page").cast("int").alias("first_page"))


ATTEMPTS = "att AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ordinal, 'psm' || l_linenumber AS config, CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE least(l_quantity * 2 + 5, 100) / 100 * (1 - CAST(l_suppkey % 3 AS DOUBLE) / 4) END AS score FROM lineitem)"


@query(s(ATTEMPTS, "b AS (SELECT *, coalesce(sum(CASE WHEN score >= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM att)", "r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ordinal) AS rk, count(*) OVER (PARTITION BY id) AS attempts FROM b WHERE before = 0)", "SELECT id, config, score, CASE WHEN score >= 0.9 THEN 'GOOD' WHEN score >= 0.75 THEN 'REVIEW' ELSE 'BAD' END AS quality, attempts FROM r WHERE rk = 1"))
def t3_ladder(spark, d):
    """Attempts up to the first good one, the best of them (also A17, B2, M10, ST3)."""
    from ..sources.binding import FLOOR_ORDER

    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy(*FLOOR_ORDER)
    words = F.concat(F.array_repeat(F.lit("w0"), (4 - F.col("l_suppkey") % 3).cast("int")), F.array_repeat(F.lit("--"), (F.col("l_suppkey") % 3).cast("int")))
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.row_number().over(w).alias("ordinal"), F.concat(F.lit("psm"), F.col("l_linenumber").cast("string")).alias("config"), words.alias("words"), (F.col("l_quantity") * 2 + 5).alias("confidence"), (F.col("l_partkey") % 13 == 0).alias("failed"))
    return pg.best_attempt(x.withColumn("score", pg.ocr_score("words", "confidence", "failed")))


SIZES = "ws AS (SELECT doc_id, line_idx, (doc_id * 7 + line_idx * 5) % 4 AS size, text FROM ln WHERE text <> '')"


@query(s(DRAWINGS, LINES, SIZES, "SELECT doc_id, arg_max(text, (size, -line_idx)) AS largest, arg_max(text, (length(text), -line_idx)) AS longest FROM ws GROUP BY doc_id"))
def t4_largest_label(spark, d):
    """The text in the largest type and the longest one, ties to the first (also T5)."""
    x = lines(spark, d).where("text <> ''").withColumn("size", (F.col("doc_id") * 7 + F.col("line_idx") * 5) % 4)
    return x.groupBy("doc_id").agg(F.max_by("text", F.struct("size", -F.col("line_idx"))).alias("largest"), F.max_by("text", F.struct(F.length("text"), -F.col("line_idx"))).alias("longest"))


@query("SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY list_position([3, 1, 4, 0, 2], n_regionkey), n_nationkey) AS place FROM nation")
def t7_display_order(spark, d):
    """A fixed order of display."""
    from pyspark.sql.window import Window

    order = F.array_position(F.array(*[F.lit(x) for x in (3, 1, 4, 0, 2)]), F.col("n_regionkey"))
    return table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.row_number().over(Window.orderBy(order, "n_nationkey")).cast("long").alias("place"))  # 25 rows


TWO = f"""v AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN {HEIGHT} END AS height, CASE WHEN doc_id % 4 > 0 THEN {STOREYS} END AS storeys, {CONSTRUCTION} AS construction_type, [doc_id] AS pages FROM drawings WHERE doc_id % 5 > 0),
o AS (SELECT p_partkey AS doc_id, CAST(p_size AS DOUBLE) AS height, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 9 + 1 AS INTEGER) END AS storeys, CAST(NULL AS VARCHAR) AS construction_type, [p_partkey + 1] AS pages FROM part WHERE p_partkey % 6 > 0),
m AS (SELECT coalesce(v.doc_id, o.doc_id) AS doc_id, coalesce(v.height, o.height) AS height, CASE WHEN v.height IS NOT NULL THEN 'first' WHEN o.height IS NOT NULL THEN 'second' END AS height_source, coalesce(v.storeys, o.storeys) AS storeys, CASE WHEN v.storeys IS NOT NULL THEN 'first' WHEN o.storeys IS NOT NULL THEN 'second' END AS storeys_source, coalesce(v.construction_type, o.construction_type) AS construction_type, CASE WHEN v.construction_type IS NOT NULL THEN 'first' END AS construction_type_source, coalesce(v.pages, []) || coalesce(o.pages, []) AS pages FROM v FULL JOIN o ON v.doc_id = o.doc_id)"""


def merged(spark, d):
    t = drawings(spark, d).where("doc_id % 5 > 0")
    first = t.select("doc_id", F.when(F.col("doc_id") % 3 > 0, tx.height("text")).alias("height"), F.when(F.col("doc_id") % 4 > 0, tx.storeys("text")).alias("storeys"), tx.construction("text").alias("construction_type"), F.array("doc_id").alias("pages"), tx.labels("text", tx.ROOM_LABELS).alias("rooms"))
    k = F.col("p_partkey")
    second = table(spark, d, "part").where("p_partkey % 6 > 0").select(k.alias("doc_id"), F.col("p_size").cast("double").alias("height"), F.when(k % 2 == 0, (F.col("p_size") % 9 + 1).cast("int")).alias("storeys"), F.lit(None).cast("string").alias("construction_type"), F.array(k + 1).alias("pages"), F.array(F.lit("HALL")).alias("rooms"))
    return mg.merge(first, second, "doc_id", ["height", "storeys", "construction_type"], ["pages"], ["rooms"])


@query(s(DRAWINGS, TWO, "SELECT doc_id, height, height_source, storeys, storeys_source, CAST(list_sum(pages) AS BIGINT) AS page_sum FROM m"))
def j12_merge(spark, d):
    """Two sources by field, the first one wins; lists follow each other."""
    return merged(spark, d).select("doc_id", "height", "height_source", "storeys", "storeys_source", F.aggregate("pages", F.lit(0).cast("long"), lambda a, x: a + x).alias("page_sum"))


FIELDS = """f AS (SELECT doc_id, 0 AS ordinal, 'height' AS field, height IS NOT NULL AS has, coalesce(height_source, '') AS source, CASE WHEN height IS NULL THEN 'red' WHEN height_source = 'first' THEN 'green' ELSE 'amber' END AS confidence FROM m
  UNION ALL SELECT doc_id, 1, 'storeys', storeys IS NOT NULL, coalesce(storeys_source, ''), CASE WHEN storeys IS NULL THEN 'red' WHEN storeys_source = 'first' THEN 'green' ELSE 'amber' END FROM m
  UNION ALL SELECT doc_id, 2, 'construction_type', construction_type IS NOT NULL, coalesce(construction_type_source, ''), CASE WHEN construction_type IS NULL THEN 'red' ELSE 'amber' END FROM m
  UNION ALL SELECT doc_id, 3, 'building_status', false, 'not_applicable', 'red' FROM m)"""


def form_fields(spark, d):
    x = merged(spark, d)
    for c in ("height", "storeys", "construction_type"):
        x = x.withColumn(f"{c}_source", F.when(F.col(f"{c}_source") == "first", "text_label").when(F.col(f"{c}_source") == "second", "tesseract"))
    return mg.fields(x, ["height", "storeys", "construction_type"])


@query(s(DRAWINGS, TWO, FIELDS, "SELECT doc_id, ordinal, field, has, CASE source WHEN 'first' THEN 'text_label' WHEN 'second' THEN 'tesseract' ELSE source END AS source, confidence FROM f"))
def f1_fields(spark, d):
    """Form fields with source and confidence."""
    return form_fields(spark, d).select("doc_id", "ordinal", "field", F.col("value").isNotNull().alias("has"), "source", "confidence")


@query(s(DRAWINGS, AREAS, TWO, FIELDS, "n AS (SELECT doc_id, count(*) FILTER (confidence = 'green') AS green, count(*) FILTER (confidence = 'amber') AS amber, count(*) FILTER (confidence = 'red') AS red FROM f GROUP BY doc_id)", "SELECT *, CAST(round_even((green * 100 + amber * 50) / greatest(1, green + amber + red), 0) AS INTEGER) AS score, CASE WHEN green > red THEN 'good' WHEN amber > red THEN 'partial' ELSE 'minimal' END AS summary FROM n"))
def a9_quality(spark, d):
    """Counts, score and band of a document's fields (also M5)."""
    return mg.quality(form_fields(spark, d))


@query(s(DRAWINGS, AREAS, "o AS (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY CASE label WHEN 'floor_area' THEN 0 ELSE 1 END) - 1 AS i FROM areas WHERE label <> 'basement_area')", "SELECT doc_id, CASE WHEN i = 0 THEN 'GF' ELSE 'F' || i END AS floor_label, value FROM o WHERE i < 20"))
def f1_floor_areas(spark, d):
    """Floor areas by place, without basements."""
    return mg.floor_fields(drawings(spark, d).select("doc_id", tx.areas("text").alias("areas")))


@query(s("p AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN text END AS name, length(text) AS n FROM conversations)", "SELECT conv_id, arg_min(name, turn) FILTER (name IS NOT NULL) AS name, string_agg(CAST(n AS VARCHAR), ',' ORDER BY turn) AS lengths FROM p GROUP BY conv_id"))
def a18_first_of_pages(spark, d):
    """The first page's value that is there, lists in page order."""
    x = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.col("text")).alias("name"), F.array(F.length("text").cast("string")).alias("lengths"))
    return mg.first_of_pages(x, "conv_id", "turn", ["name"], ["lengths"]).withColumn("lengths", F.concat_ws(",", "lengths"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'BAD' WHEN p_size % 3 = 0 THEN 'REVIEW' ELSE 'GOOD' END AS quality, CASE WHEN p_size % 10 = 0 THEN 'warning' WHEN p_size % 3 = 0 THEN 'info' ELSE 'debug' END AS level FROM part")
def k3_page_log(spark, d):
    """Log rows with a level by quality (also B5, ST5)."""
    grade = F.when(F.col("p_size") % 10 == 0, "BAD").when(F.col("p_size") % 3 == 0, "REVIEW").otherwise("GOOD")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), grade.alias("quality"), pg.log_level(grade).alias("level"))


WORDS = "length(text) >= 3 AND CAST(len(regexp_extract_all(text, '[0-9]')) AS DOUBLE) / length(text) <= 0.15"


@query(s(DRAWINGS, "w AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS text FROM drawings)", f"SELECT doc_id, count(*) AS words FROM w WHERE {WORDS} GROUP BY doc_id"))
def p9_label_words(spark, d):
    """Words long enough and with few digits."""
    w = drawings(spark, d).select("doc_id", F.explode(F.split("text", r"\s+")).alias("w"))
    n = F.length("w")
    return w.where((n >= 3) & (F.regexp_count("w", F.lit("[0-9]")) / F.nullif(n, F.lit(0)) <= 0.15)).groupBy("doc_id").agg(F.count("*").alias("words"))


@query(s(DRAWINGS, LINES, "tk AS (SELECT doc_id, line_idx AS i, text AS t FROM ln)", "x AS (SELECT doc_id, i, t, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM tk)", "SELECT doc_id, CAST(min(i) AS INTEGER) AS at FROM x WHERE contains(t, 'AREA') AND contains(coalesce(nxt, t), 'A') GROUP BY doc_id"))
def j18_split_label(spark, d):
    """A label split over adjacent tokens: the first place where both parts stand."""
    from pyspark.sql.window import Window

    x = lines(spark, d).withColumn("nxt", F.lead("text").over(Window.partitionBy("doc_id").orderBy("line_idx")))
    return x.where(F.contains("text", F.lit("AREA")) & F.contains(F.coalesce("nxt", "text"), F.lit("A"))).groupBy("doc_id").agg(F.min("line_idx").alias("at"))


@query("SELECT p_partkey AS id, kind, text, area, CASE WHEN p_partkey % 2 = 0 THEN 'mm' ELSE 'm' END AS units FROM (SELECT p_partkey, 'TEXT' AS kind, p_name AS text, CAST(0 AS DOUBLE) AS area FROM part UNION ALL SELECT p_partkey, 'LWPOLYLINE', '', CAST(p_size * (p_partkey % 13 + 1) AS DOUBLE) FROM part)")
def s10_dxf(spark, d):
    """Drawing exchange files written from rows and read back, one layer of two."""
    from ..operators.geometry import shoelace
    from ..sources.files import dxf_entities

    pair = lambda *x: F.concat_ws("\n", *[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    w, h = F.col("p_size"), F.col("p_partkey") % 13 + 1
    head = pair("0", "SECTION", "2", "HEADER", "9", "$INSUNITS", "70", F.when(F.col("p_partkey") % 2 == 0, "4").otherwise("6"), "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES")
    body = pair("0", "TEXT", "8", "PLAN", "1", F.col("p_name"), "0", "LWPOLYLINE", "8", "PLAN", "70", "1", "10", "0", "20", "0", "10", w, "20", "0", "10", w, "20", h, "10", "0", "20", h, "0", "TEXT", "8", "NOTES", "1", "skip", "0", "LINE", "8", "PLAN", "0", "ENDSEC", "0", "EOF")
    files = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("\n", head, body).alias("content"))
    x = dxf_entities(files, ["PLAN"])
    return x.select("id", "kind", "text", F.when(F.col("closed"), shoelace("points")).otherwise(0.0).alias("area"), "units")


@query()
def s5_uploads(spark, d):
    """The folder's files with their size cap and route."""
    from ..sources.files import uploads

    return uploads(spark, d + "/*.parquet", 10 << 20).select(F.substring_index("path", "/", -1).alias("name"), "length", "route", "accepted")


STAGE = "stage2_pdfplumber"  # fixed value: the stage that reads vector drawings
KINDS = {
    "project_name": "text", "city": "text", "state": "text", "building_status": "never", "primary_occupancy_hint": "guess", "height_m": "text",
    "floors_count": "text", "construction_type": "guess", "basement_area_m2": "stage", "basement_levels": "stage", "kitchen_present": "text", "sprinklers_proposed": "text",
}
FORM = f"""v AS (SELECT doc_id, {{
  'project_name': left(trim(coalesce(nullif(regexp_extract(text, {q(tx.PROJECT[0])}, 1), ''), nullif(regexp_extract(text, {q(tx.PROJECT[1])}, 1), '')), ' \t\n'), 100),
  'city': list_filter({_list(tx.CITIES)}, lambda x: contains(upper(text), upper(x)))[1], 'state': list_filter({_list(tx.STATES)}, lambda x: contains(upper(text), upper(x)))[1], 'building_status': CAST(NULL AS VARCHAR),
  'primary_occupancy_hint': list_filter({_list([k + "=" + c for k, c in tx.FORM_OCCUPANCY])}, lambda x: contains(lower(text), split_part(x, '=', 1)))[1], 'height_m': CAST({HEIGHT} AS VARCHAR), 'floors_count': CAST({STOREYS} AS VARCHAR), 'construction_type': {CONSTRUCTION},
  'basement_area_m2': CAST(nullif(CAST(nullif(regexp_extract(text, {q(tx.AREAS[0][1])}, 1), '') AS DOUBLE), 0) AS VARCHAR), 'basement_levels': CAST({_first(tx.BASEMENT_LEVELS, 1, 10, "INTEGER")} AS VARCHAR),
  'kitchen_present': CASE WHEN regexp_matches(text, '(?i)\\bkitchen\\b') THEN 'true' END, 'sprinklers_proposed': CASE WHEN regexp_matches(text, '(?i)\\bsprinkler') THEN 'true' END}} AS r FROM drawings),
form AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS ordinal, '{n}' AS field, '{k}' AS kind, " + (f"nullif(split_part(r.{n}, '=', 2), '')" if n == "primary_occupancy_hint" else f"r.{n}") + " AS value FROM v" for i, (n, k) in enumerate(KINDS.items()))})"""


@query(s(DRAWINGS, FORM, f"SELECT doc_id, ordinal, field, value, CASE kind WHEN 'text' THEN CASE WHEN value IS NULL THEN '{STAGE}' ELSE 'text_label' END WHEN 'guess' THEN CASE WHEN value IS NULL THEN '' ELSE 'text_label' END WHEN 'stage' THEN '{STAGE}' ELSE 'not_applicable' END AS source, CASE WHEN value IS NULL THEN 'red' WHEN kind = 'text' THEN 'green' ELSE 'amber' END AS confidence FROM form"))
def f6_form(spark, d):
    """The chain from a vector drawing's text to all twelve form fields, in one scan (also F1)."""
    x = F.col("text")
    values = {
        "project_name": tx.project_name("text"),
        "city": tx.first_listed("text", tx.CITIES),
        "state": tx.first_listed("text", tx.STATES),
        "building_status": F.lit(None).cast("string"),
        "primary_occupancy_hint": tx.occupancy("text", tx.FORM_OCCUPANCY)["code"],
        "height_m": tx.height("text"),
        "floors_count": tx.storeys("text"),
        "construction_type": tx.construction("text"),
        "basement_area_m2": F.nullif(tx.found("text", tx.AREAS[0][1]).cast("double"), F.lit(0.0)),
        "basement_levels": tx.basement_levels("text"),
        "kitchen_present": tx.mentions(x, r"\bkitchen\b"),
        "sprinklers_proposed": tx.mentions(x, r"\bsprinkler"),
    }
    t = drawings(spark, d).select("doc_id", *[v.alias(n) for n, v in values.items()])
    return mg.drawing_form(t, [(n, F.col(n), k) for n, k in KINDS.items()], STAGE)
