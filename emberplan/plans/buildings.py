"""Queries over buildings: catalog, loads, extinguishers, installations, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import floors as fl
from ..operators import hazard as hz
from ..operators import installs as ins
from ..operators import mixed as mx
from ..operators import result as rs
from ..sources import rules as R
from ..sources.binding import BUILDINGS, FLOORS, PRIMARY, ZONES, buildings, floors, primary_occupancy, table, zones
from .registry import query

HAZARD = """hz AS (SELECT *, CASE
  WHEN building_height > 15 OR occupant_count > 250 OR total_floor_area > 3000 OR flammable_gases_litres > 3000 OR flammable_liquids_litres > 1000 THEN 'high'
  WHEN occupant_count BETWEEN 15 AND 250 OR total_floor_area BETWEEN 300 AND 3000 OR flammable_gases_litres BETWEEN 500 AND 3000 OR flammable_liquids_litres BETWEEN 250 AND 1000 THEN 'moderate'
  ELSE 'low' END AS hazard FROM buildings)"""
TYPED = f"""{R.cte("types", R.BUILDING_TYPES)},
typed AS (SELECT b.*, t.building_type, t.grp, t.subdivision, t.nbcs_subdivision, coalesce(list_max(b.floor_areas), b.total_floor_area) AS max_area,
  coalesce(list_max(b.floor_areas), b.total_floor_area) AS tier_area,
  CASE WHEN b.number_of_floors = 1 THEN b.total_floor_area ELSE coalesce(list_max(b.floor_areas), b.total_floor_area) END AS nbcs_area
  FROM buildings b JOIN types t ON t.ordinal = b.type_ordinal)"""


def rules(spark, t):
    return R.frame(spark, t)


def typed(spark, d):
    t = rules(spark, R.BUILDING_TYPES).withColumnRenamed("ordinal", "_o")
    b = buildings(spark, d)
    out = b.join(F.broadcast(t), b["type_ordinal"] == t["_o"]).drop("_o")  # 27 rows
    out = out.withColumn("max_area", fl.max_area()).withColumn("tier_area", F.col("max_area"))
    return out.withColumn("nbcs_area", F.when(F.col("number_of_floors") == 1, F.col("total_floor_area")).otherwise(F.col("max_area")))


def s(*parts: str) -> str:
    """WITH a, b, ... and the last part as the query."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


@query(s(R.cte("r", R.SYSTEMS), R.cte("n", R.TIERS), R.cte("k", R.NOTES), "SELECT 'systems' AS tbl, count(*) AS n FROM r UNION ALL SELECT 'tiers', count(*) FROM n UNION ALL SELECT 'notes', count(*) FROM k"))
def s1_rule_tables(spark, d):
    """Rule tables as loaded."""
    parts = [rules(spark, t).agg(F.lit(n).alias("tbl"), F.count("*").alias("n")) for n, t in (("systems", R.SYSTEMS), ("tiers", R.TIERS), ("notes", R.NOTES))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(s(BUILDINGS, "SELECT building_id, total_floor_area, number_of_floors, list_max(floor_areas) AS max_area, coalesce(has_sprinklers, false) AS has_sprinklers, 'India' AS country FROM buildings"))
def s2_typed_records(spark, d):
    """JSON bodies with either spelling of a name, parsed to a schema with defaults filled in."""
    b = buildings(spark, d)
    camel = F.to_json(F.struct("building_id", F.col("floor_areas").alias("floorAreas"), F.col("total_floor_area").alias("totalFloorArea"), F.col("has_sprinklers").alias("hasSprinklers")))
    snake = F.to_json(F.struct("building_id", "floor_areas", "total_floor_area", "has_sprinklers"))
    body = b.select(F.when(F.col("building_id") % 2 == 0, camel).otherwise(snake).alias("body"))
    x = body.select(F.from_json("body", "building_id LONG, floorAreas ARRAY<DOUBLE>, floor_areas ARRAY<DOUBLE>, totalFloorArea DOUBLE, total_floor_area DOUBLE, hasSprinklers BOOLEAN, has_sprinklers BOOLEAN, country STRING").alias("x")).select("x.*")
    areas = F.coalesce("floorAreas", "floor_areas")
    return x.select("building_id", F.coalesce("totalFloorArea", "total_floor_area", F.lit(0.0)).alias("total_floor_area"), F.size(areas).alias("number_of_floors"), F.array_max(areas).alias("max_area"), F.coalesce("hasSprinklers", "has_sprinklers", F.lit(False)).alias("has_sprinklers"), F.coalesce("country", F.lit("India")).alias("country"))


SIMPLE = "SELECT building_id, building_type, grp, subdivision, total_floor_area + basement_area AS total_floor_area, len(floor_areas) AS number_of_floors, CAST(greatest(1, floor(total_floor_area / 10)) AS BIGINT) AS occupant_count FROM typed"


@query(s(BUILDINGS, TYPED, SIMPLE))
def s3_simple_records(spark, d):
    """Type and areas only: the rest is derived by lookup and arithmetic."""
    return typed(spark, d).select("building_id", "building_type", "grp", "subdivision", (F.aggregate("floor_areas", F.lit(0.0), lambda a, x: a + x) + F.col("basement_area")).alias("total_floor_area"), F.size("floor_areas").cast("long").alias("number_of_floors"), F.greatest(F.lit(1), F.floor(F.col("total_floor_area") / 10)).cast("long").alias("occupant_count"))


@query(s(FLOORS, ZONES, BUILDINGS, f"SELECT building_id, {PRIMARY} AS primary_occupancy, split_part({PRIMARY}, '-', 1) AS grp, CAST(coalesce(n, 0) AS BIGINT) AS zones, CAST(coalesce(a, 0) AS DOUBLE) AS zone_area FROM buildings LEFT JOIN (SELECT building_id, count(*) AS n, sum(area_m2) AS a FROM zones GROUP BY 1) USING (building_id)"))
def s4_mixed_records(spark, d):
    """Nested selections parsed from JSON: primary, its group, zones (also P5)."""
    z = zones(spark, d).groupBy("building_id").agg(F.collect_list(F.struct("occupancy_code", "area_m2")).alias("occupancyZones"))
    b = buildings(spark, d).select("building_id", primary_occupancy().alias("primaryOccupancy"))
    body = b.join(z, "building_id", "left").select(F.to_json(F.struct("building_id", "primaryOccupancy", "occupancyZones")).alias("body"))
    x = body.select(F.from_json("body", "building_id LONG, primaryOccupancy STRING, occupancyZones ARRAY<STRUCT<occupancy_code: STRING, area_m2: DOUBLE>>").alias("x")).select("x.*")
    area = F.aggregate(F.transform("occupancyZones", lambda z: z["area_m2"]), F.lit(0.0), lambda a, v: a + v)
    return x.select("building_id", F.col("primaryOccupancy").alias("primary_occupancy"), F.substring_index("primaryOccupancy", "-", 1).alias("grp"), F.coalesce(F.size("occupancyZones"), F.lit(0)).cast("long").alias("zones"), F.coalesce(area, F.lit(0.0)).alias("zone_area"))


@query(s(BUILDINGS, "SELECT building_id, number_of_floors * 2 AS fields, has_kitchen AS kitchen FROM buildings"))
def k1_json_sink(spark, d):
    """JSON rows with camelCase names, read back as a consumer would."""
    out = buildings(spark, d).select(F.to_json(F.struct(F.col("building_id").alias("buildingId"), F.col("number_of_floors").alias("numberOfFloors"), F.col("has_kitchen").alias("hasKitchen"))).alias("json"))
    j = lambda p: F.get_json_object("json", p)
    return out.select(j("$.buildingId").cast("long").alias("building_id"), (j("$.numberOfFloors").cast("int") * 2).alias("fields"), j("$.hasKitchen").cast("boolean").alias("kitchen"))


@query(s(R.cte("t", R.BUILDING_TYPES), "SELECT ordinal, building_type FROM t"))
def c1_building_types(spark, d):
    return rules(spark, R.BUILDING_TYPES).select("ordinal", "building_type").orderBy("ordinal")


@query(s(R.cte("t", R.BUILDING_TYPES), "SELECT grp, string_agg(DISTINCT subdivision, ',' ORDER BY subdivision) AS subdivisions, count(*) AS types FROM t GROUP BY grp"))
def c2_occupancy_tree(spark, d):
    return rules(spark, R.BUILDING_TYPES).groupBy("grp").agg(F.nullif(F.concat_ws(",", F.array_sort(F.collect_set("subdivision"))), F.lit("")).alias("subdivisions"), F.count("*").alias("types"))


@query(s(R.cte("p", R.PRESETS), R.cte("a", R.APPLICABILITY), "x AS (SELECT ordinal, preset, unnest(occupancies) AS code FROM p)", "SELECT x.ordinal, x.preset, x.code, a.label FROM x LEFT JOIN a ON a.key = CASE WHEN x.code LIKE 'G-%' THEN x.code ELSE split_part(x.code, '-', 1) END"))
def c3_presets(spark, d):
    """Mixed presets with their occupancies' labels."""
    x = rules(spark, R.PRESETS).select("ordinal", "preset", F.explode("occupancies").alias("code"))
    key = F.when(F.col("code").startswith("G-"), F.col("code")).otherwise(F.substring_index("code", "-", 1))
    return x.join(rules(spark, R.APPLICABILITY).select("key", "label"), key == F.col("key"), "left").select("ordinal", "preset", "code", "label")


@query(s(FLOORS, "SELECT building_id, floor_idx, CASE WHEN floor_idx = 0 THEN 'Ground Floor' ELSE 'Floor ' || floor_idx END AS floor_label, area FROM floors"))
def p1_floor_labels(spark, d):
    """Floors unnested from each building's list, with labels."""
    return fl.unnest_floors(buildings(spark, d)).select("building_id", "floor_idx", fl.floor_label("floor_idx").alias("floor_label"), "area")


@query(s(BUILDINGS, "SELECT building_id, list_contains(list_transform(floor_areas, lambda x: x > 40), false) AS small_floor, construction_type IS NULL AS no_type, coalesce(travel_distance_m, 0) <= 0 AS no_distance FROM buildings WHERE list_contains(list_transform(floor_areas, lambda x: x > 40), false) OR construction_type IS NULL"))
def p3_rejects(spark, d):
    """Rows that fail an input check, with what failed."""
    b = buildings(spark, d).withColumn("small_floor", ~F.forall("floor_areas", lambda x: x > 40))
    return b.where("small_floor or construction_type is null").select("building_id", "small_floor", F.col("construction_type").isNull().alias("no_type"), (F.coalesce("travel_distance_m", F.lit(0.0)) <= 0).alias("no_distance"))


@query("SELECT c_custkey AS id, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END), ''), 'Unnamed Building') AS building_name, coalesce(nullif(trim(CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END), ''), 'General') AS building_type, replace(coalesce(nullif(trim(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END), ''), nullif(trim(c_mktsegment), ''), 'report'), ' ', '_') AS file_name FROM customer")
def p4_defaults(spark, d):
    """Names and types filled in where blank, and the report's file name."""
    c = table(spark, d, "customer")
    filled = lambda col: F.nullif(F.trim(col), F.lit(""))
    name = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name"))
    kind = F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment"))
    file = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name"))
    return c.select(F.col("c_custkey").alias("id"), F.coalesce(filled(name), F.lit("Unnamed Building")).alias("building_name"), F.coalesce(filled(kind), F.lit("General")).alias("building_type"), F.replace(F.coalesce(filled(file), filled(F.col("c_mktsegment")), F.lit("report")), F.lit(" "), F.lit("_")).alias("file_name"))


@query(s(BUILDINGS, TYPED, "raw AS (SELECT building_id, grp, CASE WHEN building_id % 4 = 0 THEN [total_floor_area] ELSE floor_areas END AS areas, CASE WHEN building_id % 3 = 0 THEN total_floor_area * 2 ELSE total_floor_area END AS total, CASE WHEN building_id % 5 > 0 THEN occupant_count END AS occ, CASE WHEN building_id % 2 = 0 THEN building_height END AS h, construction_type FROM typed)", "x AS (SELECT *, list_sum(areas) AS total_sum FROM raw)", "y AS (SELECT *, CASE WHEN abs(total - total_sum) / total_sum > 0.05 THEN total_sum ELSE total END AS t FROM x)", "SELECT building_id, CAST(len(areas) AS INTEGER) AS number_of_floors, t AS total_floor_area, CAST(coalesce(occ, floor(t / CASE grp WHEN 'D' THEN 3 WHEN 'A' THEN 15 ELSE 10 END + 0.5)) AS BIGINT) AS occupant_count, coalesce(h, len(areas) * 3.5) AS building_height, coalesce(construction_type, 'type12') AS construction_type FROM y"))
def p8_repair(spark, d):
    """An ordered chain of repairs: floors, total, occupants, height, construction (also M4)."""
    b = typed(spark, d)
    k = F.col("building_id")
    x = b.select("building_id", "grp", F.when(k % 4 == 0, F.array("total_floor_area")).otherwise(F.col("floor_areas")).alias("areas"), F.when(k % 3 == 0, F.col("total_floor_area") * 2).otherwise(F.col("total_floor_area")).alias("total"), F.when(k % 5 > 0, F.col("occupant_count")).alias("occ"), F.when(k % 2 == 0, F.col("building_height")).alias("h"), "construction_type")
    x = x.withColumn("areas", F.when(F.size("areas") > 0, F.col("areas")).otherwise(F.array("total"))).withColumn("number_of_floors", F.size("areas"))
    x = x.withColumn("sum", F.aggregate("areas", F.lit(0.0), lambda a, v: a + v))
    x = x.withColumn("total_floor_area", F.when(F.abs(F.col("total") - F.col("sum")) / F.col("sum") > 0.05, F.col("sum")).otherwise(F.col("total")))
    density = F.when(F.col("grp") == "D", 3).when(F.col("grp") == "A", 15).otherwise(10)
    return x.select("building_id", "number_of_floors", "total_floor_area", F.coalesce(F.col("occ").cast("long"), F.floor(F.col("total_floor_area") / density + 0.5)).alias("occupant_count"), F.coalesce("h", F.col("number_of_floors") * 3.5).alias("building_height"), F.coalesce("construction_type", F.lit("type12")).alias("construction_type"))


@query(s(R.cte("t", R.BUILDING_TYPES), R.cte("a", R.APPLICABILITY), "SELECT t.ordinal, q.term FROM t LEFT JOIN a ON a.key = t.grp, (VALUES ('hotel'), ('a-'), ('Storage'), ('business'), ('zzz')) AS q(term) WHERE contains(lower(t.building_type), lower(trim(q.term))) OR contains(lower(coalesce(t.subdivision, t.grp)), lower(trim(q.term))) OR contains(lower(coalesce(a.label, '')), lower(trim(q.term)))"))
def p10_catalog_search(spark, d):
    """Types that contain a search term in their name, code or group label."""
    t = rules(spark, R.BUILDING_TYPES)
    a = rules(spark, R.APPLICABILITY).select("key", "label")
    t = t.join(a, t["grp"] == a["key"], "left")
    terms = spark.createDataFrame([("hotel",), ("a-",), ("Storage",), ("business",), ("zzz",)], "term string")
    q = F.lower(F.trim("term"))
    hit = F.contains(F.lower("building_type"), q) | F.contains(F.lower(F.coalesce("subdivision", "grp")), q) | F.contains(F.lower(F.coalesce("label", F.lit(""))), q)
    return t.join(F.broadcast(terms), hit).select("ordinal", "term")  # a catalog of 27 rows against the terms asked for


@query(s(BUILDINGS, "n AS (SELECT building_id, floor_areas, least(200, greatest(1, number_of_floors + building_id % 3 - 1)) AS n FROM buildings)", "SELECT building_id, CAST(n AS INTEGER) AS floors, list_sum(list_transform(range(1, n + 1), lambda i: coalesce(floor_areas[i], 0))) AS filled, list_sum(list_transform(range(1, n + 1), lambda i: coalesce(floor_areas[i], floor_areas[len(floor_areas)]))) AS padded FROM n"))
def p15_align_floors(spark, d):
    """Areas cut or filled to a number of floors: with 0, or with the last area."""
    b = buildings(spark, d).withColumn("floors", F.least(F.lit(200), F.greatest(F.lit(1), F.col("number_of_floors") + (F.col("building_id") % 3).cast("int") - 1)))
    total = lambda fill: F.aggregate(F.transform(F.sequence(F.lit(0), F.col("floors") - 1), lambda i: F.coalesce(F.get("floor_areas", i), fill)), F.lit(0.0), lambda a, x: a + x)
    return b.select("building_id", "floors", total(F.lit(0.0)).alias("filled"), total(F.element_at("floor_areas", -1)).alias("padded"))


@query(s(BUILDINGS, TYPED, "SELECT building_id, building_type, grp, subdivision, nbcs_subdivision FROM typed"))
def j1_type_map(spark, d):
    return typed(spark, d).select("building_id", "building_type", "grp", "subdivision", "nbcs_subdivision")


SUB = "CASE building_id % 4 WHEN 0 THEN 'concentrated' WHEN 1 THEN 'outdoor' WHEN 2 THEN 'upper' END"


@query(s(BUILDINGS, TYPED, R.cte("l", R.LOAD), f"k AS (SELECT building_id, grp, {SUB} AS sub_type FROM typed)", "SELECT k.building_id, coalesce((SELECT factor FROM l WHERE l.grp = k.grp AND l.sub_type = k.sub_type), (SELECT factor FROM l WHERE l.grp = k.grp AND l.sub_type = 'default'), (SELECT arg_min(factor, ordinal) FROM l WHERE l.grp = k.grp)) AS load_factor FROM k"))
def j2_load_factor(spark, d):
    """Sub-type, else default, else the first number."""
    k = typed(spark, d).withColumn("sub_type", F.expr(SUB))
    return fl.load_factor(k, rules(spark, R.LOAD), "grp", "sub_type").select("building_id", "load_factor")


LOADED = f"""{R.cte("l", R.LOAD)}, {R.cte("e", R.EXIT)},
fx AS (SELECT t.building_id, f.area, coalesce((SELECT factor FROM l WHERE l.grp = t.grp AND l.sub_type = 'default'), (SELECT arg_min(factor, ordinal) FROM l WHERE l.grp = t.grp)) AS load_factor, e.stairway_mm, e.level_mm
  FROM typed t JOIN floors f USING (building_id) LEFT JOIN e ON e.grp = t.grp)"""


def loaded(spark, d):
    """Floors with their building's factors: unnested from one row a building, so nothing is shuffled again."""
    e = rules(spark, R.EXIT).withColumnRenamed("grp", "_ge")
    b = typed(spark, d).select("building_id", "grp", "floor_areas", "total_floor_area")
    b = fl.load_factor(b, rules(spark, R.LOAD))
    b = b.join(F.broadcast(e), F.col("grp") == F.col("_ge"), "left")  # ten rows
    return fl.unnest_floors(b, fallback=True)


@query(s(FLOORS, BUILDINGS, TYPED, LOADED, "SELECT building_id, max(load_factor) AS load_factor, CAST(sum(floor(area / load_factor)) AS BIGINT) AS total_occupants, CAST(max(floor(area / load_factor)) AS BIGINT) AS max_occupants, sum(area) AS total_area FROM fx WHERE load_factor IS NOT NULL GROUP BY building_id"))
def a1_occupant_load(spark, d):
    return fl.occupant_load(loaded(spark, d))


@query(s(FLOORS, BUILDINGS, TYPED, LOADED, f"SELECT building_id, CAST(sum(floor(area / load_factor)) AS BIGINT) AS total_occupants, round_even(max(greatest(floor(area / load_factor) * stairway_mm, {R.EXIT_MIN_MM})), 1) AS max_stairway_width_mm, round_even(max(greatest(floor(area / load_factor) * level_mm, {R.EXIT_MIN_MM})), 1) AS max_level_width_mm FROM fx WHERE load_factor IS NOT NULL AND stairway_mm IS NOT NULL GROUP BY building_id"))
def a2_exit_capacity(spark, d):
    return fl.exit_capacity(loaded(spark, d), R.EXIT_MIN_MM)


@query(s(FLOORS, "SELECT building_id, CAST(sum(ceil(area / (CAST(2.8 AS DOUBLE) * CAST(2.8 AS DOUBLE)))) AS BIGINT) AS total_sprinklers, CAST(sum(ceil(area / 25.0)) AS BIGINT) AS total_smoke_detectors, CAST(7.84 AS DOUBLE) AS sprinkler_coverage_m2, CAST(25.0 AS DOUBLE) AS smoke_detector_coverage_m2 FROM floors GROUP BY building_id"))
def a3_detectors(spark, d):
    return fl.detector_counts(floors(spark, d))


@query(s(FLOORS, BUILDINGS, HAZARD, R.cte("c", R.CLASS_A), "SELECT f.building_id, f.floor_idx, CASE WHEN f.floor_idx = 0 THEN 'Ground Floor' ELSE 'Floor ' || f.floor_idx END AS floor_label, h.hazard, c.rating, CAST(greatest(ceil(f.area / c.max_area), CASE WHEN f.area < 100 THEN 1 ELSE 2 END) AS BIGINT) AS count FROM floors f JOIN hz h USING (building_id) JOIN c ON c.hazard = h.hazard"))
def a4_class_a(spark, d):
    """Class A extinguishers by floor under the building's hazard."""
    f = fl.unnest_floors(hz.with_hazard(buildings(spark, d)))
    return fl.extinguishers(f, rules(spark, R.CLASS_A)).select("building_id", "floor_idx", "floor_label", "hazard", "rating", "count")


@query(s(FLOORS, BUILDINGS, HAZARD, R.cte("c", R.CLASS_B), "SELECT h.building_id, any_value(c.rating) AS rating, CAST(sum(greatest(ceil(f.area / c.max_area), CASE WHEN f.area < 100 THEN 1 ELSE 2 END)) AS BIGINT) AS count FROM floors f JOIN hz h USING (building_id) JOIN c ON c.hazard = h.hazard WHERE h.has_flammable_liquids GROUP BY h.building_id"))
def a4_class_b(spark, d):
    f = fl.unnest_floors(hz.with_hazard(buildings(spark, d).where("has_flammable_liquids")))
    return fl.extinguishers(f, rules(spark, R.CLASS_B)).groupBy("building_id").agg(F.first("rating").alias("rating"), F.sum("count").alias("count"))


@query(s(BUILDINGS, R.cte("f", R.CLASS_F), "SELECT b.building_id, coalesce(f.rating, '75F') AS rating, CAST(CASE WHEN f.rating IS NULL THEN ceil(b.cooking_area_m2 / 0.25) ELSE 1 END AS BIGINT) AS count FROM buildings b LEFT JOIN f ON b.cooking_area_m2 > f.above AND b.cooking_area_m2 <= f.upto WHERE b.has_kitchen AND b.cooking_area_m2 > 0"))
def j7_class_f(spark, d):
    """The band of a cooking area, or as many as it takes above all bands."""
    k = buildings(spark, d).where("has_kitchen and cooking_area_m2 > 0").select("building_id", "cooking_area_m2")
    return fl.class_f("cooking_area_m2", rules(spark, R.CLASS_F), k).select("building_id", "rating", "count")


REASONS = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"


@query(s(BUILDINGS, HAZARD, "SELECT building_id, hazard, array_to_string(list_filter(CASE hazard WHEN 'high' THEN [CASE WHEN building_height > 15 THEN 'height' END, CASE WHEN occupant_count > 250 THEN 'occupants' END, CASE WHEN total_floor_area > 3000 THEN 'area' END, CASE WHEN flammable_gases_litres > 3000 THEN 'gas' END, CASE WHEN flammable_liquids_litres > 1000 THEN 'liquid' END] ELSE [CASE WHEN occupant_count BETWEEN 15 AND 250 THEN 'occupants' END, CASE WHEN total_floor_area BETWEEN 300 AND 3000 THEN 'area' END, CASE WHEN flammable_gases_litres BETWEEN 500 AND 3000 THEN 'gas' END, CASE WHEN flammable_liquids_litres BETWEEN 250 AND 1000 THEN 'liquid' END] END, lambda x: x IS NOT NULL), ',') AS reasons FROM hz"))
def r1_hazard(spark, d):
    return hz.with_hazard(buildings(spark, d)).select("building_id", "hazard", F.concat_ws(",", "hazard_reasons").alias("reasons"))


@query(s(BUILDINGS, "SELECT building_id, 'C' AS fire_class, 'CO2-2kg' AS rating, CAST(1 AS BIGINT) AS count FROM buildings WHERE has_electrical_hazards"))
def r2_electrical(spark, d):
    return hz.electrical(buildings(spark, d))


TRAVEL = f"""{R.cte("td", R.TRAVEL)},
tr AS (SELECT t.*, CASE WHEN td.key IS NOT NULL AND construction_type IS NOT NULL THEN coalesce(CASE WHEN construction_type = 'type12' THEN td.type12 ELSE td.type34 END, -1) END AS base_m
  FROM typed t LEFT JOIN td ON td.key = CASE WHEN t.grp = 'G' AND t.subdivision IN ('G-1', 'G-2', 'G-3') THEN t.subdivision ELSE t.grp END),
trv AS (SELECT *, CASE WHEN base_m > 0 AND coalesce(has_sprinklers, false) THEN base_m * CAST({R.SPRINKLER_BONUS} AS DOUBLE) ELSE base_m END AS max_m FROM tr),
travelled AS (SELECT *, CASE WHEN max_m = -1 THEN 'NBC-TD-NOT-PERMITTED' WHEN coalesce(travel_distance_m, 0) > max_m THEN 'NBC-TD-EXCEED' END AS td_rule FROM trv)"""


def travelled(spark, d):
    return ins.travel(typed(spark, d), rules(spark, R.TRAVEL), R.SPRINKLER_BONUS)


@query(s(BUILDINGS, TYPED, TRAVEL, "SELECT building_id, base_m, max_m, td_rule FROM travelled"))
def r5_travel(spark, d):
    return travelled(spark, d).select("building_id", "base_m", "max_m", "td_rule")


LIMITED = f"""{R.cte("hl", R.HEIGHT_LIMIT)},
limited AS (SELECT t.*, l.max_height AS limit_m, coalesce(t.building_height > l.max_height, false) AS over_height FROM typed t
  LEFT JOIN hl l ON l.key = CASE WHEN t.subdivision IN (SELECT key FROM hl) THEN t.subdivision ELSE t.grp END)"""


@query(s(BUILDINGS, TYPED, LIMITED, "SELECT building_id, coalesce(subdivision, grp) AS occupancy, limit_m AS max_height, over_height FROM limited WHERE limit_m IS NOT NULL"))
def r6_height_limit(spark, d):
    """Subdivision's limit, else the group's."""
    return ins.over_height(typed(spark, d), rules(spark, R.HEIGHT_LIMIT)).where("max_height is not null").select("building_id", F.coalesce("subdivision", "grp").alias("occupancy"), "max_height", "over_height")


def _tiered(rows: str, area: str, out: str) -> str:
    """First tier by range, else the last of the key, in window form."""
    return f"""{out}k AS (SELECT r.*, CASE WHEN r.subdivision IN (SELECT key FROM tiers) THEN r.subdivision WHEN r.grp IN (SELECT key FROM tiers) THEN r.grp END AS rule_key FROM {rows} r WHERE NOT r.over_height),
{out}m AS (SELECT k.*, t.* EXCLUDE (key, min_height, max_height, min_area, max_area, min_floors, max_floors),
    (k.building_height <= t.max_height AND (t.min_height IS NULL OR k.building_height >= t.min_height)
     AND (t.max_area IS NULL OR coalesce({area}, 0) <= 0 OR {area} <= t.max_area) AND (t.min_area IS NULL OR coalesce({area}, 0) <= 0 OR {area} >= t.min_area)
     AND (t.max_floors IS NULL OR k.number_of_floors <= 0 OR k.number_of_floors <= t.max_floors) AND (t.min_floors IS NULL OR k.number_of_floors <= 0 OR k.number_of_floors >= t.min_floors)) AS matched
  FROM {out}k k JOIN tiers t ON t.key = k.rule_key),
{out} AS (SELECT * FROM {out}m QUALIFY row_number() OVER (PARTITION BY building_id, subdivision ORDER BY matched DESC, CASE WHEN matched THEN tier_idx ELSE -tier_idx END) = 1)"""


TIERED = f"{R.cte('tiers', R.TIERS)}, {_tiered('limited', 'k.tier_area', 'tiered')}"


@query(s(BUILDINGS, TYPED, LIMITED, TIERED, "SELECT building_id, rule_key, tier_idx, label AS tier_label FROM tiered"))
def j5_tier_first_match(spark, d):
    """First tier that holds, else the last one."""
    x = ins.over_height(typed(spark, d), rules(spark, R.HEIGHT_LIMIT)).where("not over_height")
    t = rules(spark, R.TIERS)
    x = ins.first_tier(ins.keyed(x, t), t).where("tier is not null")
    return x.select("building_id", "rule_key", "tier.tier_idx", F.col("tier.label").alias("tier_label"))


# Closed form of the ordered fold: what was set last, or the tier's value, and what was added since.
FOLDED = f"""{R.cte("notes", R.NOTES)},
met AS (SELECT x.building_id, x.subdivision AS sub, n.* FROM {{rows}} x JOIN notes n ON n.key = x.rule_key AND n.tier_idx = x.tier_idx
  WHERE CASE n.cond WHEN 'always' THEN true WHEN 'basement_area_gt_200' THEN x.basement_area > 200 WHEN 'floors_gt_2' THEN x.number_of_floors > 2 WHEN 'floors_gt_1' THEN x.number_of_floors > 1 WHEN 'height_gte_15' THEN x.building_height >= 15 WHEN 'height_gte_60' THEN x.building_height >= 60 ELSE false END),
sets AS (SELECT building_id, sub, field, max(note_idx) AS last FROM met WHERE set_value IS NOT NULL GROUP BY ALL),
adds AS (SELECT m.building_id, m.sub, m.field, sum(m.additional) AS added FROM met m LEFT JOIN sets s ON s.building_id = m.building_id AND s.sub IS NOT DISTINCT FROM m.sub AND s.field = m.field
  WHERE m.set_value IS NULL AND m.additional IS NOT NULL AND m.note_idx > coalesce(s.last, -1) GROUP BY ALL),
flags AS (SELECT DISTINCT building_id, sub, field FROM met WHERE set_value IS NULL AND additional IS NULL),
folded AS (SELECT x.* EXCLUDE ({", ".join(R.FLAGS + R.AMOUNTS)}), {", ".join(f"x.{f} OR EXISTS (SELECT 1 FROM flags g WHERE g.building_id = x.building_id AND g.sub IS NOT DISTINCT FROM x.subdivision AND g.field = '{f}') AS {f}" for f in R.FLAGS)},
  {", ".join(f"CAST(CASE WHEN s_{a}.v IS NULL AND a_{a}.added IS NULL THEN x.{a} ELSE coalesce(s_{a}.v, x.{a}, 0) + coalesce(a_{a}.added, 0) END AS INTEGER) AS {a}" for a in R.AMOUNTS)}
  FROM {{rows}} x {" ".join(f"LEFT JOIN (SELECT s.building_id, s.sub, m.set_value AS v FROM sets s JOIN met m ON m.building_id = s.building_id AND m.sub IS NOT DISTINCT FROM s.sub AND m.field = s.field AND m.note_idx = s.last WHERE s.field = '{a}') s_{a} ON s_{a}.building_id = x.building_id AND s_{a}.sub IS NOT DISTINCT FROM x.subdivision LEFT JOIN (SELECT * FROM adds WHERE field = '{a}') a_{a} ON a_{a}.building_id = x.building_id AND a_{a}.sub IS NOT DISTINCT FROM x.subdivision" for a in R.AMOUNTS)})"""


def installed(spark, d):
    return ins.installations(typed(spark, d), *(rules(spark, t) for t in (R.HEIGHT_LIMIT, R.TIERS, R.NOTES)))


INSTALLED = (BUILDINGS, TYPED, LIMITED, TIERED, FOLDED.replace("{rows}", "tiered"))


@query(s(*INSTALLED, f"SELECT building_id, label AS tier_label, {', '.join(R.FLAGS + R.AMOUNTS)} FROM folded"))
def r7_note_fold(spark, d):
    """Installations of a tier with its notes applied in order."""
    return installed(spark, d).where("tier_label is not null").select("building_id", "tier_label", *R.FLAGS, *R.AMOUNTS)


WATER = " OR ".join(f"coalesce({a}, 0) > 0" for a in R.AMOUNTS)


@query(s(*INSTALLED, f"""c AS (
  SELECT building_id, 0 AS ordinal, 'Fire Extinguishers' AS system, '' AS triggers FROM folded WHERE fire_extinguisher
  UNION ALL SELECT building_id, 1, 'Internal Hydrants & Hose Reels', concat_ws(',', CASE WHEN first_aid_hose_reel THEN 'Hose Reel' END, CASE WHEN wet_riser THEN 'Wet Riser' END, CASE WHEN down_comer THEN 'Down Comer' END) FROM folded WHERE first_aid_hose_reel OR wet_riser OR down_comer
  UNION ALL SELECT building_id, 2, 'External (Yard) Hydrants', '' FROM folded WHERE yard_hydrant
  UNION ALL SELECT building_id, 3, 'Water Supply & Fire Pumps', '' FROM folded WHERE {WATER}
  UNION ALL SELECT building_id, 4, 'Automatic Sprinkler System', '' FROM folded WHERE automatic_sprinkler
  UNION ALL SELECT building_id, 5, 'Fire Detection & Alarm', concat_ws(',', CASE WHEN auto_detection_alarm THEN 'Auto Detection' END, CASE WHEN manual_fire_alarm THEN 'Manual Alarm' END) FROM folded WHERE auto_detection_alarm OR manual_fire_alarm)""", "SELECT * FROM c"))
def r12_cards(spark, d):
    return ins.system_cards(installed(spark, d)).withColumn("triggers", F.concat_ws(",", "triggers"))


VIOLATIONS = f"""violations AS (
  SELECT building_id, 4 AS stage, 'F-MISSING-AREA' AS rule_id, 'medium' AS severity FROM typed WHERE has_kitchen AND coalesce(cooking_area_m2, 0) <= 0
  UNION ALL SELECT building_id, 6, 'D-PROFESSIONAL', 'high' FROM typed WHERE has_combustible_metals
  UNION ALL SELECT building_id, 7, td_rule, 'high' FROM travelled WHERE td_rule IS NOT NULL
  UNION ALL SELECT building_id, 8, 'NBC-FI-HEIGHT-NOT-PERMITTED', 'high' FROM limited WHERE over_height)"""


def scored(b):
    """Rows with td_rule and over_height, with their violations as an array, and the score of these."""
    return rs.with_score(b.withColumn("violations", rs.findings()))


def checked(spark, d):
    """Every building with its violations and score: one row, made by one scan of the floors."""
    return scored(ins.over_height(travelled(spark, d), rules(spark, R.HEIGHT_LIMIT)))


@query(s(BUILDINGS, TYPED, TRAVEL, LIMITED, VIOLATIONS, "SELECT * FROM violations"))
def u1_violations(spark, d):
    """Violations of every check, in stage order."""
    return checked(spark, d).select("building_id", F.inline("violations")).drop("clause_ref")


SCORED = "scored AS (SELECT b.building_id, CAST(count(v.rule_id) AS BIGINT) AS violations, CAST(greatest(0, 100 - coalesce(sum(CASE v.severity WHEN 'high' THEN 20 WHEN 'medium' THEN 10 END), 0)) AS INTEGER) AS score FROM typed b LEFT JOIN violations v USING (building_id) GROUP BY b.building_id)"


@query(s(BUILDINGS, TYPED, TRAVEL, LIMITED, VIOLATIONS, SCORED, "SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade, CASE WHEN score >= 90 THEN 'READY' WHEN score >= 60 THEN 'CONDITIONAL' ELSE 'NOT_READY' END AS noc FROM scored"))
def r15_score_grade(spark, d):
    """Weighted penalties, grade and readiness."""
    return checked(spark, d).select("building_id", F.size("violations").cast("long").alias("violations"), "score", "grade", "noc")


@query(s(*INSTALLED, TRAVEL, VIOLATIONS, SCORED, HAZARD, "SELECT h.building_id, h.hazard, s.score, s.violations, f.label AS tier_label, coalesce(f.wet_riser, false) AS wet_riser, f.underground_tank_litres FROM hz h JOIN scored s USING (building_id) LEFT JOIN folded f USING (building_id)"))
def r16_engine(spark, d):
    """Headline figures of each building; r16_result has the whole evaluation."""
    b = ins.installations(travelled(spark, d), *(rules(spark, x) for x in (R.HEIGHT_LIMIT, R.TIERS, R.NOTES)))
    b = scored(hz.with_hazard(b)).withColumn("wet_riser", F.coalesce("wet_riser", F.lit(False)))
    return b.select("building_id", "hazard", "score", F.size("violations").cast("long").alias("violations"), "tier_label", "wet_riser", "underground_tank_litres")


@query(s(BUILDINGS, "b AS (SELECT building_id, CASE WHEN building_id % 6 = 0 THEN 0 ELSE total_floor_area END AS total_floor_area, CASE WHEN building_id % 8 = 0 THEN number_of_floors + 1 ELSE number_of_floors END AS n, CASE WHEN building_id % 10 = 0 THEN [] ELSE floor_areas END AS fa, CASE WHEN building_id % 5 = 0 THEN occupant_count * 9 ELSE occupant_count END AS occ, CASE WHEN building_id % 12 = 0 THEN 0 ELSE building_height END AS h FROM buildings)",
    """x AS (SELECT building_id, [CASE WHEN total_floor_area <= 0 THEN 'area' END, CASE WHEN n <= 0 THEN 'floors' END, CASE WHEN len(fa) = 0 THEN 'floor_areas' END, CASE WHEN len(fa) > 0 AND n <> 0 AND len(fa) <> n THEN 'floor_count' END, CASE WHEN occ <= 0 THEN 'occupants' END, CASE WHEN h <= 0 THEN 'height' END, CASE WHEN total_floor_area > 50000 THEN 'large' END, CASE WHEN n > 20 THEN 'tall' END, CASE WHEN occ > 5000 THEN 'crowded' END,
    CASE WHEN len(fa) > 0 AND total_floor_area > 0 AND abs(total_floor_area - list_sum(fa)) / total_floor_area > 0.1 THEN 'sum' END, CASE WHEN occ > 0 AND total_floor_area > 0 AND total_floor_area / occ < 2 THEN 'dense' END, CASE WHEN occ > 0 AND total_floor_area > 0 AND total_floor_area / occ > 50 THEN 'sparse' END, CASE WHEN h > 0 AND n > 0 AND (h / n < 2.5 OR h / n > 6) THEN 'storey' END] AS f FROM b)""",
    "p(flag, points) AS (VALUES ('area', 30), ('floors', 20), ('floor_areas', 25), ('floor_count', 15), ('occupants', 10), ('height', 10), ('large', 10), ('tall', 5), ('crowded', 5), ('sum', 10), ('dense', 10), ('sparse', 5), ('storey', 5))",
    "y AS (SELECT x.building_id, list_filter(f, lambda v: v IS NOT NULL) AS f FROM x)",
    "z AS (SELECT y.building_id, y.f, CAST(greatest(0, 100 - coalesce((SELECT sum(points) FROM p WHERE list_contains(y.f, p.flag)), 0)) AS INTEGER) AS score FROM y)",
    "SELECT building_id, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS overall, array_to_string(f, ',') AS flags FROM z"))
def r17_confidence(spark, d):
    """Extraction confidence of damaged inputs."""
    k = F.col("building_id")
    b = buildings(spark, d).select(
        "building_id",
        F.when(k % 6 == 0, 0.0).otherwise(F.col("total_floor_area")).alias("total_floor_area"),
        F.when(k % 8 == 0, F.col("number_of_floors") + 1).otherwise(F.col("number_of_floors")).alias("number_of_floors"),
        F.when(k % 10 == 0, F.array().cast("array<double>")).otherwise(F.col("floor_areas")).alias("floor_areas"),
        F.when(k % 5 == 0, F.col("occupant_count") * 9).otherwise(F.col("occupant_count")).alias("occupant_count"),
        F.when(k % 12 == 0, 0.0).otherwise(F.col("building_height")).alias("building_height"),
    )
    return hz.confidence(b).withColumn("flags", F.concat_ws(",", "flags"))


@query(s(BUILDINGS, "SELECT building_id, concat_ws(',', CASE WHEN basement_area = 0 AND basement_count > 0 THEN 'basement_area' END, CASE WHEN construction_type IS NULL THEN 'construction_type' END) AS missing FROM buildings"))
def r18_missing_inputs(spark, d):
    return buildings(spark, d).select("building_id", F.concat_ws(",", hz.missing_inputs()).alias("missing"))


@query(s(BUILDINGS, TYPED, R.cte("a", R.APPLICABILITY), "SELECT t.building_id, a.label, a.key IS NOT NULL AND coalesce(t.building_height > a.height_m, true) AS height_applies, coalesce(t.max_area > a.area_m2, false) AS area_applies, (a.key IS NOT NULL AND coalesce(t.building_height > a.height_m, true)) OR coalesce(t.max_area > a.area_m2, false) AS applicable FROM typed t LEFT JOIN a ON a.key = CASE WHEN t.subdivision IN (SELECT key FROM a) THEN t.subdivision ELSE t.grp END"))
def r9_applicability(spark, d):
    return ins.applicability(typed(spark, d), rules(spark, R.APPLICABILITY)).select("building_id", "label", "height_applies", "area_applies", "applicable")


NBCS = f"""{R.cte("nt", R.NBCS_TIERS)},
nm AS (SELECT b.*, t.level AS tier_level, t.tier_idx AS nbcs_tier, t.self_area, t.self_height, {", ".join(f"t.{f} AS n_{f}" for f in R.NBCS_FLAGS)} FROM typed b JOIN nt t ON t.grp = b.grp AND t.sub = b.nbcs_subdivision
  AND (t.min_height IS NULL OR b.building_height >= t.min_height) AND (t.max_height IS NULL OR b.building_height <= t.max_height) AND (t.min_area IS NULL OR b.nbcs_area >= t.min_area) AND (t.max_area IS NULL OR b.nbcs_area <= t.max_area)
  QUALIFY row_number() OVER (PARTITION BY b.building_id ORDER BY t.tier_idx) = 1),
nk AS (SELECT *, CASE WHEN has_kitchen AND grp = 'A' AND tier_level = 'HL-1' THEN 'HL-2' ELSE tier_level END AS l1, coalesce(nbcs_area <= self_area AND building_height <= self_height, false) AS self_cert FROM nm),
ne AS (SELECT *, coalesce(has_ev_parking AND (l1 LIKE 'HL%' OR l1 IN ('CL-2', 'CL-3', 'CL-4')), false) AS ev FROM nk),
nbcs AS (SELECT *, CASE WHEN self_cert THEN 'SELF-CERT' WHEN ev THEN 'CL-5' ELSE l1 END AS level, CASE WHEN ev THEN true ELSE n_automatic_sprinkler END AS n_sprinkler FROM ne)"""


@query(s(BUILDINGS, TYPED, NBCS, "SELECT building_id, nbcs_tier, level, self_cert, n_sprinkler AS nbcs_automatic_sprinkler, n_wet_riser AS nbcs_wet_riser, n_public_address AS nbcs_public_address FROM nbcs"))
def r10_nbcs_installations(spark, d):
    """First tier without a fallback, then upgrades in order."""
    return ins.nbcs_installations(typed(spark, d), rules(spark, R.NBCS_TIERS)).select("building_id", "nbcs_tier", "level", "self_cert", "nbcs_automatic_sprinkler", "nbcs_wet_riser", "nbcs_public_address")


@query(s(*INSTALLED, NBCS, "SELECT n.building_id, n.n_sprinkler IS DISTINCT FROM f.automatic_sprinkler OR n.n_yard_hydrant IS DISTINCT FROM f.yard_hydrant OR n.n_wet_riser IS DISTINCT FROM f.wet_riser AS differs FROM nbcs n JOIN folded f USING (building_id)"))
def j11_differs(spark, d):
    """Whether two rule layers disagree, null-safe."""
    both = ins.nbcs_installations(installed(spark, d).where("tier_label is not null"), rules(spark, R.NBCS_TIERS))
    return both.select("building_id", ins.differs().alias("differs"))


@query(s(BUILDINGS, TYPED, R.cte("l", R.NBCS_LOAD), R.cte("e", R.NBCS_EXIT), R.cte("v", R.NBCS_TRAVEL),
    "x AS (SELECT t.*, coalesce((SELECT coalesce(gross, net) FROM l WHERE l.grp = t.grp AND l.sub = t.nbcs_subdivision), (SELECT coalesce(gross, net) FROM l WHERE l.grp = t.grp AND l.sub = 'default')) AS factor FROM typed t)",
    "SELECT x.building_id, CAST(trunc(total_floor_area / factor) AS BIGINT) AS nbcs_occupants, trunc(max_area / coalesce(factor, 12.5)) * e.stairway_mm AS nbcs_stairway_mm, trunc(max_area / coalesce(factor, 12.5)) * e.level_mm AS nbcs_level_mm, e.dead_end_m, CASE WHEN a.key IS NOT NULL THEN coalesce(b.metres, a.metres) END AS nbcs_travel_m FROM x JOIN e ON e.grp = x.grp LEFT JOIN v a ON a.key = x.grp LEFT JOIN v b ON b.key = x.nbcs_subdivision"))
def r11_nbcs_tables(spark, d):
    """Occupants, widths, dead ends and distances of the second layer (also M3)."""
    m = ins.nbcs_metrics(typed(spark, d).select("building_id", "grp", "nbcs_subdivision", "total_floor_area", "max_area"), *(rules(spark, t) for t in (R.NBCS_LOAD, R.NBCS_EXIT, R.NBCS_TRAVEL)))
    return m.select("building_id", "nbcs_occupants", "nbcs_stairway_mm", "nbcs_level_mm", "dead_end_m", "nbcs_travel_m")


CODES = f"""zc AS (SELECT building_id, occupancy_code AS code, min(floor_idx) AS ordinal, max(area_m2) AS zone_area FROM zones GROUP BY ALL
  UNION ALL SELECT building_id, {PRIMARY}, -1, NULL FROM buildings WHERE {PRIMARY} IS NOT NULL),
codes AS (SELECT building_id, code, min(ordinal) AS ordinal, max(zone_area) AS zone_area FROM zc GROUP BY ALL)"""
MIXED = (
    FLOORS,
    ZONES,
    BUILDINGS,
    CODES,
    R.cte("hl", R.HEIGHT_LIMIT),
    R.cte("tiers", R.TIERS),
    "mrows AS (SELECT c.building_id, c.code AS subdivision, split_part(c.code, '-', 1) AS grp, c.ordinal, coalesce(c.zone_area, list_max(b.floor_areas), b.total_floor_area) AS tier_area, b.building_height, b.number_of_floors, b.basement_area, coalesce(b.building_height > l.max_height, false) AS over_height FROM codes c JOIN buildings b USING (building_id) LEFT JOIN hl l ON l.key = CASE WHEN c.code IN (SELECT key FROM hl) THEN c.code ELSE split_part(c.code, '-', 1) END)",
    _tiered("mrows", "k.tier_area", "mixed"),
    FOLDED.replace("{rows}", "mixed"),
)


def evaluated(spark, d):
    b = buildings(spark, d)
    codes = mx.occupancy_codes(b, zones(spark, d), primary_occupancy())
    return mx.evaluate(codes, b, *(rules(spark, t) for t in (R.HEIGHT_LIMIT, R.TIERS, R.NOTES)))


@query(s(FLOORS, ZONES, BUILDINGS, CODES, "SELECT building_id, string_agg(code, ',' ORDER BY ordinal, code) AS codes FROM codes GROUP BY building_id"))
def u5_occupancy_codes(spark, d):
    """Primary and zone codes, each once, in order."""
    c = mx.occupancy_codes(buildings(spark, d), zones(spark, d), primary_occupancy())
    return c.groupBy("building_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "code"))), lambda x: x["code"])).alias("codes"))


ITEMS = f"""{R.cte("sys", R.SYSTEMS)},
on_rows AS ({" UNION ALL ".join(f"SELECT building_id, ordinal, subdivision AS code, '{f}' AS field, {f} AS lit FROM folded" for f in R.FLAGS)}),
items AS (SELECT o.building_id, s.id, s.clause, s.standards, s.title, coalesce(string_agg(o.code, ',' ORDER BY o.ordinal, o.code) FILTER (o.lit), '') AS triggered_by, count(*) FILTER (o.lit) > 0 AS required, any_value(o.field) AS field FROM on_rows o JOIN sys s ON s.field = o.field GROUP BY ALL)"""


@query(s(*MIXED, ITEMS, """cl AS (SELECT DISTINCT o.building_id, o.field, 'Table 7 Note ' || m.note_id AS clause FROM on_rows o JOIN met m ON m.building_id = o.building_id AND m.sub = o.code AND m.field = o.field WHERE o.lit
  UNION SELECT building_id, field, clause FROM items)""", "SELECT i.building_id, i.id, CASE WHEN i.required THEN 'required' ELSE 'not_required' END AS status, i.triggered_by, string_agg(c.clause, ';' ORDER BY c.clause) AS clauses FROM items i JOIN cl c ON c.building_id = i.building_id AND c.field = i.field GROUP BY ALL"))
def r14_mixed_items(spark, d):
    """Strictest of many: a system is required if any occupancy requires it."""
    items = mx.system_items(evaluated(spark, d), R.system_rows())
    return items.select("building_id", "id", "status", F.concat_ws(",", "triggered_by").alias("triggered_by"), F.concat_ws(";", "clauses").alias("clauses"))


@query(s(*MIXED, f"""am AS ({" UNION ALL ".join(f"SELECT building_id, ordinal, subdivision AS code, '{a}' AS field, {a} AS v FROM folded WHERE {a} IS NOT NULL" for a in R.AMOUNTS)}),
mxm AS (SELECT building_id, field, max(v) AS value FROM am GROUP BY ALL)""", "SELECT m.building_id, m.field, CAST(m.value AS BIGINT) AS value, string_agg(a.code, ',' ORDER BY a.ordinal, a.code) AS triggered_by FROM mxm m JOIN am a ON a.building_id = m.building_id AND a.field = m.field AND a.v = m.value GROUP BY ALL"))
def a6_max_with_ties(spark, d):
    """The greatest amount with everyone who asks for it."""
    return mx.strictest_amounts(evaluated(spark, d)).withColumn("triggered_by", F.concat_ws(",", "triggered_by"))


@query(s(*MIXED, ITEMS, "st AS (SELECT building_id, title, unnest(standards) AS standard FROM items WHERE required)", "SELECT building_id, standard, string_agg(DISTINCT title, ',' ORDER BY title) AS titles FROM st GROUP BY ALL"))
def a7_bis_grid(spark, d):
    """Standards of required systems with their titles."""
    return mx.standards_grid(evaluated(spark, d), R.system_rows()).withColumn("titles", F.concat_ws(",", "titles"))


@query(s(R.cte("x", R.STANDARD_TRIGGERS), R.cte("sy", R.SYSTEMS), "t AS (SELECT standard, unnest(triggers) AS system FROM x)", "SELECT t.system, string_agg(t.standard, ',' ORDER BY t.standard) AS standards, any_value(sy.title) AS title FROM t LEFT JOIN sy ON sy.id = t.system GROUP BY t.system"))
def j19_standard_triggers(spark, d):
    """Standards looked up by the system that triggers them."""
    t = rules(spark, R.STANDARD_TRIGGERS).select("standard", F.explode("triggers").alias("system"))
    sy = rules(spark, R.SYSTEMS).select("id", "title")
    return t.join(sy, t["system"] == sy["id"], "left").groupBy("system").agg(F.concat_ws(",", F.array_sort(F.collect_list("standard"))).alias("standards"), F.first("title", ignorenulls=True).alias("title"))


@query(s(BUILDINGS, "SELECT building_id, list_max(floor_areas) AS max_area, CAST(greatest(72, least(300, trunc(8000 / (total_floor_area / 72)))) AS INTEGER) AS dpi, sqrt(CAST(150 AS DOUBLE) / pi()) AS radius_m, CASE WHEN building_height > 15 THEN 180000 * number_of_floors ELSE 95000 * number_of_floors END AS riser_cost FROM buildings"))
def a19_building_figures(spark, d):
    """Largest floor, capped resolution, coverage radius, costs."""
    return buildings(spark, d).select("building_id", fl.max_area().alias("max_area"), F.greatest(F.lit(72), F.least(F.lit(300), (8000 / (F.col("total_floor_area") / 72)).cast("int"))).alias("dpi"), F.sqrt(F.lit(150.0) / F.pi()).alias("radius_m"), F.when(F.col("building_height") > 15, 180000 * F.col("number_of_floors")).otherwise(95000 * F.col("number_of_floors")).alias("riser_cost"))


@query(s(BUILDINGS, TYPED, HAZARD, "SELECT t.grp, h.hazard, count(*) AS n, sum(t.total_floor_area) AS area, grouping(t.grp, h.hazard) AS level FROM typed t JOIN hz h USING (building_id) GROUP BY CUBE (t.grp, h.hazard)"))
def ext_hazard_cube(spark, d):
    """Beyond the reference: a cube of buildings by group and hazard."""
    return hz.with_hazard(typed(spark, d)).cube("grp", "hazard").agg(F.count("*").alias("n"), F.sum("total_floor_area").alias("area"), F.grouping_id().alias("level"))
