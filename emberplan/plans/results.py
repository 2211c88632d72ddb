"""Queries over whole evaluations: requirements, passed checks, results, report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import floors as fl
from ..operators import hazard as hz
from ..operators import installs as ins
from ..operators import mixed as mx
from ..operators import result as rs
from ..sources import messages as M
from ..sources import rules as R
from ..sources.binding import BUILDINGS, FLOORS, ZONES, buildings, primary_occupancy, table, zones
from .buildings import CODES, FOLDED, HAZARD, INSTALLED, ITEMS, LIMITED, LOADED, MIXED, NBCS, SCORED, TRAVEL, TYPED, VIOLATIONS, evaluated, rules, s, scored, travelled
from .registry import query


def required(spark, b):
    """Buildings with a hazard and their extinguishers."""
    return rs.with_requirements(b, *(rules(spark, t) for t in (R.CLASS_A, R.CLASS_B, R.CLASS_F)))


def passing(spark, d):
    """Every building with what its checks need and the messages of those that passed."""
    e = rules(spark, R.EXIT).withColumnRenamed("grp", "_ge")
    b = fl.load_factor(travelled(spark, d), rules(spark, R.LOAD))
    b = b.join(F.broadcast(e), F.col("grp") == F.col("_ge"), "left").drop("_ge")  # ten rows
    b = ins.installations(b, *(rules(spark, t) for t in (R.HEIGHT_LIMIT, R.TIERS, R.NOTES)))
    b = ins.applicability(rs.with_floor_figures(b, R.EXIT_MIN_MM), rules(spark, R.APPLICABILITY))
    return b.withColumn("passed", rs.passed_checks())


def whole(spark, d):
    """Every building's whole evaluation, one row each; floors are aggregated once."""
    b = required(spark, hz.with_hazard(passing(spark, d)))
    b = ins.nbcs_installations(b, rules(spark, R.NBCS_TIERS), keep=True)
    b = b.drop("stairway_mm", "level_mm")  # the second layer has widths of the same names
    b = ins.nbcs_metrics(b, *(rules(spark, t) for t in (R.NBCS_LOAD, R.NBCS_EXIT, R.NBCS_TRAVEL)), keep=True)
    return scored(b)


def sql_text(*parts: str) -> str:
    """printf of a format with arguments as text."""
    fmt, *args = parts
    quoted = "'" + fmt.replace("'", "''") + "'"
    return f"printf({quoted}, {', '.join(f'CAST({a} AS VARCHAR)' for a in args)})" if args else quoted


LABEL = "CASE WHEN f.floor_idx = 0 THEN 'Ground Floor' ELSE 'Floor ' || f.floor_idx END"
COUNT = "CAST(greatest(ceil(f.area / c.max_area), CASE WHEN f.area < 100 THEN 1 ELSE 2 END) AS BIGINT)"
REQUIRED = f"""{R.cte("ca", R.CLASS_A)}, {R.cte("cb", R.CLASS_B)}, {R.cte("cf", R.CLASS_F)},
req AS (SELECT f.building_id, 0 AS k, f.floor_idx, 'A' AS fire_class, {LABEL} AS floor_label, c.rating, {COUNT} AS count FROM floors f JOIN hz h USING (building_id) JOIN ca c ON c.hazard = h.hazard
  UNION ALL SELECT f.building_id, 1, f.floor_idx, 'B', {LABEL}, c.rating, {COUNT} FROM floors f JOIN hz h USING (building_id) JOIN cb c ON c.hazard = h.hazard WHERE h.has_flammable_liquids
  UNION ALL SELECT b.building_id, 2, 0, 'F', NULL, coalesce(c.rating, '75F'), CAST(CASE WHEN c.rating IS NULL THEN ceil(b.cooking_area_m2 / 0.25) ELSE 1 END AS BIGINT) FROM buildings b LEFT JOIN cf c ON b.cooking_area_m2 > c.above AND b.cooking_area_m2 <= c.upto WHERE b.has_kitchen AND b.cooking_area_m2 > 0
  UNION ALL SELECT building_id, 3, 0, 'C', NULL, 'CO2-2kg', 1 FROM buildings WHERE has_electrical_hazards)"""


@query(s(FLOORS, BUILDINGS, TYPED, HAZARD, REQUIRED, "SELECT building_id, CAST(row_number() OVER (PARTITION BY building_id ORDER BY k, floor_idx) - 1 AS INTEGER) AS ordinal, fire_class, floor_label, rating, count FROM req"))
def u1_requirements(spark, d):
    """Extinguishers of every class in order, inlined from the building's row."""
    return required(spark, hz.with_hazard(buildings(spark, d))).select("building_id", F.posexplode("required").alias("ordinal", "r")).select("building_id", "ordinal", "r.*")


DEVICES = "concat_ws(', ', " + ", ".join(f"CASE WHEN {f} THEN '{t}' END" for f, t in M.DEVICES.items()) + ")"
REASON = f"""CASE WHEN p.key IS NULL THEN {sql_text(M.NO_THRESHOLD, "t.grp")}
  WHEN p.height_m IS NULL OR t.building_height > p.height_m OR t.max_area > p.area_m2 THEN concat_ws('; ',
    CASE WHEN p.height_m IS NULL THEN {sql_text(M.ANY_HEIGHT)} WHEN t.building_height > p.height_m THEN {sql_text(M.ABOVE_HEIGHT, "t.building_height", "p.height_m", "p.label")} END,
    CASE WHEN t.max_area > p.area_m2 THEN {sql_text(M.ABOVE_AREA, "t.max_area", "p.area_m2", "p.label")} END)
  ELSE {sql_text(M.BELOW_BOTH, "t.building_height", "p.height_m", "t.max_area", "p.area_m2", "p.label")} END"""
PASSED = f"""{R.cte("ap", R.APPLICABILITY)},
fsum AS (SELECT building_id, any_value(load_factor) AS load_factor, any_value(stairway_mm) AS stairway_mm, any_value(level_mm) AS level_mm, count(*) AS n, CAST(sum(floor(area / load_factor)) AS BIGINT) AS total_occupants, CAST(max(floor(area / load_factor)) AS BIGINT) AS max_occupants,
  round_even(max(greatest(floor(area / load_factor) * stairway_mm, {R.EXIT_MIN_MM})), 1) AS max_stairway_width_mm, round_even(max(greatest(floor(area / load_factor) * level_mm, {R.EXIT_MIN_MM})), 1) AS max_level_width_mm,
  CAST(sum(ceil(area / (CAST(2.8 AS DOUBLE) * CAST(2.8 AS DOUBLE)))) AS BIGINT) AS total_sprinklers, CAST(sum(ceil(area / 25.0)) AS BIGINT) AS total_smoke_detectors FROM fx GROUP BY building_id),
said AS (SELECT t.building_id, p.key IS NOT NULL AND (p.height_m IS NULL OR t.building_height > p.height_m OR t.max_area > p.area_m2) AS applicable, {REASON} AS reason
  FROM typed t LEFT JOIN ap p ON p.key = CASE WHEN t.subdivision IN (SELECT key FROM ap) THEN t.subdivision ELSE t.grp END),
passed AS (SELECT building_id, 1 AS ordinal, {sql_text(M.CLASS_A, "len(floor_areas)")} AS message FROM typed
  UNION ALL SELECT building_id, 2, {sql_text(M.CLASS_B)} FROM typed WHERE has_flammable_liquids
  UNION ALL SELECT building_id, 3, {sql_text(M.CLASS_F)} FROM typed WHERE has_kitchen AND cooking_area_m2 > 0
  UNION ALL SELECT building_id, 4, {sql_text(M.ELECTRICAL)} FROM typed WHERE has_electrical_hazards
  UNION ALL SELECT building_id, 5, {sql_text(M.LOAD, "x.total_occupants", "x.n", "t.grp", "x.load_factor", "x.max_occupants")} FROM fsum x JOIN typed t USING (building_id) WHERE x.load_factor IS NOT NULL
  UNION ALL SELECT building_id, 6, {sql_text(M.EXITS, "stairway_mm", "level_mm", "max_stairway_width_mm", "max_level_width_mm")} FROM fsum WHERE load_factor IS NOT NULL AND level_mm IS NOT NULL
  UNION ALL SELECT building_id, 7, {sql_text(M.TRAVEL, f"CASE WHEN coalesce(travel_distance_m, 0) <> 0 THEN {sql_text(M.TRAVEL_WITHIN, 'travel_distance_m', 'max_m')} ELSE {sql_text(M.TRAVEL_ALLOWED, 'max_m')} END", "grp", "construction_type", f"CASE WHEN base_m > 0 AND coalesce(has_sprinklers, false) THEN '{M.SPRINKLERED}' ELSE '' END")} FROM travelled WHERE max_m IS NOT NULL AND td_rule IS NULL
  UNION ALL SELECT building_id, 8, {sql_text(M.INSTALLED, "label", DEVICES)} FROM folded WHERE building_height > 0
  UNION ALL SELECT building_id, 9, {sql_text(M.DETECTORS, "total_sprinklers", "total_smoke_detectors")} FROM fsum
  UNION ALL SELECT building_id, 10, CASE WHEN applicable THEN {sql_text(M.APPLIES, "reason")} ELSE {sql_text(M.APPLIES_NOT, "reason")} END FROM said)"""
CHECKED = (FLOORS, *INSTALLED, TRAVEL, LOADED, PASSED)


@query(s(*CHECKED, "SELECT building_id, ordinal, message FROM passed"))
def u1_passed_rules(spark, d):
    """Messages of the checks that passed, in order."""
    return passing(spark, d).select("building_id", F.inline("passed"))


RESULT = """SELECT t.building_id, h.hazard, s.score, CASE WHEN s.score >= 90 THEN 'A' WHEN s.score >= 75 THEN 'B' WHEN s.score >= 60 THEN 'C' ELSE 'D' END AS grade, CASE WHEN s.score >= 90 THEN 'READY' WHEN s.score >= 60 THEN 'CONDITIONAL' ELSE 'NOT_READY' END AS noc,
  (SELECT string_agg(concat_ws(' ', fire_class, rating, count), ',' ORDER BY k, floor_idx) FROM req WHERE req.building_id = t.building_id) AS requirements,
  coalesce((SELECT string_agg(rule_id, ',' ORDER BY stage) FROM violations v WHERE v.building_id = t.building_id), '') AS violations,
  (SELECT string_agg(message, '|' ORDER BY ordinal) FROM passed p WHERE p.building_id = t.building_id) AS passed_rules,
  x.total_occupants, x.max_occupants, x.max_stairway_width_mm, x.max_level_width_mm, tr.base_m, tr.max_m, f.label AS tier_label, coalesce(f.wet_riser, false) AS wet_riser, x.total_sprinklers, x.total_smoke_detectors, sd.applicable AS nbcs_applicable, n.level AS nbcs_level, coalesce(n.self_cert, false) AS self_cert,
  CAST(trunc(t.total_floor_area / coalesce((SELECT coalesce(gross, net) FROM nl WHERE nl.grp = t.grp AND nl.sub = t.nbcs_subdivision), (SELECT coalesce(gross, net) FROM nl WHERE nl.grp = t.grp AND nl.sub = 'default'))) AS BIGINT) AS nbcs_occupants
FROM typed t JOIN hz h USING (building_id) JOIN scored s USING (building_id) JOIN fsum x USING (building_id) JOIN travelled tr USING (building_id) LEFT JOIN folded f USING (building_id) JOIN said sd USING (building_id) LEFT JOIN nbcs n USING (building_id)"""


@query(s(*CHECKED, VIOLATIONS, SCORED, HAZARD, REQUIRED, NBCS, R.cte("nl", R.NBCS_LOAD), RESULT))
def r16_result(spark, d):
    """The whole evaluation of a building as one row, its lists as text."""
    b = whole(spark, d)
    return b.select(
        "building_id", "hazard", "score", "grade", "noc",
        F.concat_ws(",", F.transform("required", lambda r: F.concat_ws(" ", r["fire_class"], r["rating"], r["count"].cast("string")))).alias("requirements"),
        F.concat_ws(",", F.transform("violations", lambda v: v["rule_id"])).alias("violations"),
        F.concat_ws("|", F.transform("passed", lambda p: p["message"])).alias("passed_rules"),
        "total_occupants", "max_occupants", "max_stairway_width_mm", "max_level_width_mm", "base_m", "max_m", "tier_label",
        F.coalesce("wet_riser", F.lit(False)).alias("wet_riser"), "total_sprinklers", "total_smoke_detectors",
        F.col("applicable").alias("nbcs_applicable"), F.col("level").alias("nbcs_level"), F.coalesce("self_cert", F.lit(False)).alias("self_cert"), "nbcs_occupants",
    )


@query(s(*MIXED[:-1], "SELECT m.building_id, m.ordinal, m.subdivision AS code, CASE WHEN m.over_height THEN 'above_height_limit' ELSE 'no_tier' END AS reason FROM mrows m WHERE NOT EXISTS (SELECT 1 FROM mixed x WHERE x.building_id = m.building_id AND x.subdivision = m.subdivision)"))
def r14_dropped_codes(spark, d):
    """Occupancies that a mixed building's evaluation leaves out, with the reason."""
    b = buildings(spark, d)
    codes = mx.occupancy_codes(b, zones(spark, d), primary_occupancy())
    return mx.dropped(mx.evaluate(codes, b, *(rules(spark, t) for t in (R.HEIGHT_LIMIT, R.TIERS, R.NOTES)), keep=True))


CLAUSED = """cl AS (SELECT DISTINCT o.building_id, o.field, 'Table 7 Note ' || m.note_id AS clause FROM on_rows o JOIN met m ON m.building_id = o.building_id AND m.sub = o.code AND m.field = o.field WHERE o.lit
  UNION SELECT building_id, field, clause FROM items)"""
WHO = "replace(i.triggered_by, ',', ', ')"


@query(s(*MIXED, ITEMS, CLAUSED, f"""SELECT i.building_id, i.title AS system, CASE WHEN i.required THEN 'REQUIRED' ELSE 'NOT REQUIRED' END AS status,
  CASE WHEN NOT i.required THEN {sql_text(M.NOT_REQUIRED)} {" ".join(f"WHEN i.id = '{k}' THEN {sql_text(v, WHO)}" for k, v in M.REQUIRED_OF.items())} ELSE {sql_text(M.REQUIRED, WHO)} END AS reason,
  coalesce(nullif({WHO}, ''), '{M.DASH}') AS triggered_by, string_agg(c.clause, ' · ' ORDER BY c.clause) AS clauses FROM items i JOIN cl c ON c.building_id = i.building_id AND c.field = i.field GROUP BY ALL"""))
def p14_installations(spark, d):
    """The report's table of systems: status, reason, who asks for it, clauses; a dash for none."""
    systems = R.system_rows()
    items = mx.system_items(evaluated(spark, d), systems)
    title = F.create_map(*[F.lit(x) for r in systems for x in (r["id"], r["title"])])
    who = F.concat_ws(", ", "triggered_by")
    reason = F.when(F.size("triggered_by") == 0, F.lit(M.NOT_REQUIRED))
    for k, v in M.REQUIRED_OF.items():
        reason = reason.when(F.col("id") == k, F.format_string(v, who))
    dashed = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit(M.DASH))
    return items.select("building_id", title[F.col("id")].alias("system"), F.upper(F.replace("status", F.lit("_"), F.lit(" "))).alias("status"), reason.otherwise(F.format_string(M.REQUIRED, who)).alias("reason"), dashed(who).alias("triggered_by"), dashed(F.concat_ws(" · ", "clauses")).alias("clauses"))


STRICTEST = f"""am AS ({" UNION ALL ".join(f"SELECT building_id, ordinal, subdivision AS code, '{a}' AS field, {a} AS v FROM folded WHERE {a} IS NOT NULL" for a in R.AMOUNTS)}),
mxm AS (SELECT building_id, field, max(v) AS value FROM am GROUP BY ALL),
names(field, quantity, unit) AS (VALUES {", ".join(f"('{k}', '{n}', '{u}')" for k, (n, u) in M.AMOUNTS.items())})"""


@query(s(*MIXED, STRICTEST, "SELECT m.building_id, n.quantity, format('{:,}', CAST(m.value AS BIGINT)) || ' ' || n.unit AS value, string_agg(a.code, ', ' ORDER BY a.ordinal, a.code) AS triggered_by FROM mxm m JOIN names n USING (field) JOIN am a ON a.building_id = m.building_id AND a.field = m.field AND a.v = m.value GROUP BY ALL"))
def a12_quantities(spark, d):
    """The report's table of water quantities."""
    named = F.create_map(*[F.lit(x) for k, (n, _) in M.AMOUNTS.items() for x in (k, n)])
    unit = F.create_map(*[F.lit(x) for k, (_, u) in M.AMOUNTS.items() for x in (k, u)])
    rows = mx.strictest_amounts(evaluated(spark, d))
    return rows.select("building_id", named[F.col("field")].alias("quantity"), F.concat_ws(" ", F.format_number("value", 0), unit[F.col("field")]).alias("value"), F.concat_ws(", ", "triggered_by").alias("triggered_by"))


PLACED = "placed AS (SELECT b.building_id, n.n_name AS city, r.r_name AS state FROM buildings b LEFT JOIN customer c ON c.c_custkey = b.customer LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey)"


@query(s(FLOORS, ZONES, BUILDINGS, CODES, PLACED, f"""oc AS (SELECT building_id, string_agg(code, ' · ' ORDER BY ordinal, code) AS codes FROM codes GROUP BY building_id)""", f"""SELECT b.building_id, unnest([1, 2, 3, 4, 5, 6]) AS ordinal, unnest(['Location', 'Height', 'Floors', 'Total Floor Area', 'Basement Area', 'Occupancies']) AS label,
  unnest([CASE WHEN p.city IS NULL AND p.state IS NULL THEN '{M.DASH}' ELSE coalesce(p.city, '') || ', ' || coalesce(p.state, '') END, CAST(b.building_height AS VARCHAR) || ' m', CAST(b.number_of_floors AS VARCHAR), format('{{:,.0f}}', b.total_floor_area) || ' m²', CASE WHEN b.basement_area > 0 THEN format('{{:,.0f}}', b.basement_area) || ' m²' ELSE '{M.DASH}' END, coalesce(oc.codes, '{M.DASH}')]) AS value
FROM buildings b JOIN placed p USING (building_id) LEFT JOIN oc USING (building_id)"""))
def a12_summary(spark, d):
    """The report's first table: a row for each label, a dash where nothing is known."""
    b = buildings(spark, d)
    codes = mx.occupancy_codes(b, zones(spark, d), primary_occupancy())
    oc = codes.groupBy("building_id").agg(F.concat_ws(" · ", F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "code"))), lambda x: x["code"])).alias("codes"))
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    place = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    x = b.join(place.select("c_custkey", F.col("n_name").alias("city"), F.col("r_name").alias("state")), F.col("customer") == F.col("c_custkey"), "left").join(oc, "building_id", "left")
    none = F.lit(M.DASH)
    area = lambda c: F.concat(F.format_number(c, 0), F.lit(" m²"))
    rows = [
        ("Location", F.when(F.col("city").isNull() & F.col("state").isNull(), none).otherwise(F.concat(F.coalesce("city", F.lit("")), F.lit(", "), F.coalesce("state", F.lit(""))))),
        ("Height", F.concat(F.col("building_height").cast("string"), F.lit(" m"))),
        ("Floors", F.col("number_of_floors").cast("string")),
        ("Total Floor Area", area("total_floor_area")),
        ("Basement Area", F.when(F.col("basement_area") > 0, area("basement_area")).otherwise(none)),
        ("Occupancies", F.coalesce("codes", none)),
    ]
    return x.select("building_id", F.inline(F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(n).alias("label"), v.alias("value")) for i, (n, v) in enumerate(rows)])))


@query(s(*CHECKED, f"""mi AS (SELECT building_id, 0 AS ordinal, {sql_text(M.BASEMENT_MISSING)} AS item FROM typed WHERE basement_area = 0 AND basement_count > 0 UNION ALL SELECT building_id, 1, {sql_text(M.CONSTRUCTION_MISSING)} FROM typed WHERE construction_type IS NULL)""", f"""SELECT building_id, 'Passed Checks' AS section, CAST(row_number() OVER (PARTITION BY building_id ORDER BY ordinal) - 1 AS INTEGER) AS ordinal, '• ' || message AS bullet FROM passed
UNION ALL SELECT building_id, 'Missing Inputs', CAST(row_number() OVER (PARTITION BY building_id ORDER BY ordinal) - 1 AS INTEGER), '• ' || item FROM mi
UNION ALL SELECT building_id, 'Missing Inputs', 0, '{M.NONE}' FROM typed WHERE building_id NOT IN (SELECT building_id FROM mi)"""))
def a12_bullets(spark, d):
    """The report's lists; an empty one says so."""
    b = passing(spark, d)
    hints = {"basement_area": M.BASEMENT_MISSING, "construction_type": M.CONSTRUCTION_MISSING}
    wording = F.create_map(*[F.lit(x) for kv in hints.items() for x in kv])
    bullets = lambda items: F.when(F.size(items) == 0, F.array(F.lit(M.NONE))).otherwise(F.transform(items, lambda m: F.concat(F.lit("• "), m)))
    sections = F.array(
        F.struct(F.lit("Passed Checks").alias("section"), bullets(F.transform("passed", lambda p: p["message"])).alias("bullets")),
        F.struct(F.lit("Missing Inputs").alias("section"), bullets(F.transform(hz.missing_inputs(), lambda h: wording[h])).alias("bullets")),
    )
    return b.select("building_id", F.inline(sections)).select("building_id", "section", F.posexplode("bullets").alias("ordinal", "bullet"))


MOST_PIXELS = 1536  # fixed value: the longest side of a picture that is sent on


@query(f"SELECT p_partkey AS id, CASE WHEN w <= {MOST_PIXELS} AND h <= {MOST_PIXELS} THEN w ELSE CAST(trunc(w * least({MOST_PIXELS}::DOUBLE / w, {MOST_PIXELS}::DOUBLE / h)) AS INTEGER) END AS width, CASE WHEN w <= {MOST_PIXELS} AND h <= {MOST_PIXELS} THEN h ELSE CAST(trunc(h * least({MOST_PIXELS}::DOUBLE / w, {MOST_PIXELS}::DOUBLE / h)) AS INTEGER) END AS height FROM (SELECT p_partkey, CAST(p_size * 97 + 200 AS INTEGER) AS w, CAST(p_partkey % 3100 + 50 AS INTEGER) AS h FROM part)")
def m9_resize(spark, d):
    """Sides of a picture scaled down, in proportion, to the longest allowed."""
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 97 + 200).cast("int").alias("w"), (F.col("p_partkey") % 3100 + 50).cast("int").alias("h"))
    most = F.lit(float(MOST_PIXELS))
    fits = (F.col("w") <= most) & (F.col("h") <= most)
    ratio = F.least(most / F.col("w"), most / F.col("h"))
    return x.select("id", *[F.when(fits, F.col(c)).otherwise((F.col(c) * ratio).cast("int")).alias(n) for c, n in (("w", "width"), ("h", "height"))])
