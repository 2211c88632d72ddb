"""Golden cases of whole evaluations."""

from pyspark.sql import functions as F

from emberplan.operators import hazard as hz
from emberplan.operators import result as rs
from emberplan.sources import rules as R

SCHEMA = (
    "building_id LONG, floor_areas ARRAY<DOUBLE>, total_floor_area DOUBLE, building_height DOUBLE, occupant_count INT, flammable_gases_litres DOUBLE, flammable_liquids_litres DOUBLE, "
    "has_flammable_liquids BOOLEAN, has_kitchen BOOLEAN, cooking_area_m2 DOUBLE, has_electrical_hazards BOOLEAN, load_factor DOUBLE, stairway_mm DOUBLE, level_mm DOUBLE"
)


def test_requirements(spark):
    rows = [
        (1, [1250.0] * 4, 5000.0, 16.0, 500, 0.0, 1500.0, True, True, 0.06, True, 10.0, 10.0, 6.5),
        (2, [150.0], 150.0, 3.0, 5, 0.0, 0.0, False, False, None, False, 10.0, 10.0, 6.5),
        (3, [], 99.0, None, None, None, None, None, None, None, None, None, None, None),
    ]
    b = rs.with_requirements(hz.with_hazard(spark.createDataFrame(rows, SCHEMA)), *(R.frame(spark, t) for t in (R.CLASS_A, R.CLASS_B, R.CLASS_F)))
    got = {r["building_id"]: (r["hazard"], [(x["fire_class"], x["rating"], x["count"]) for x in r["required"]]) for r in b.collect()}
    assert got[1] == ("high", [("A", "4A", 13)] * 4 + [("B", "233B", 13)] * 4 + [("F", "25F", 1), ("C", "CO2-2kg", 1)])
    assert got[2] == ("low", [("A", "2A", 2)])
    assert got[3] == ("low", [])


def test_floor_figures(spark):
    rows = [
        (1, [1000.0, 255.0], 1255.0, 3.0, 5, 0.0, 0.0, False, False, None, False, 10.0, 10.0, 6.5),
        (2, [], 99.0, 3.0, 5, 0.0, 0.0, False, False, None, False, None, 10.0, None),
    ]
    b = rs.with_floor_figures(spark.createDataFrame(rows, SCHEMA), 1000.0)
    one, two = b.orderBy("building_id").collect()
    assert (one["total_occupants"], one["max_occupants"], one["max_stairway_width_mm"], one["max_level_width_mm"]) == (125, 100, 1000.0, 1000.0)
    assert (one["total_sprinklers"], one["total_smoke_detectors"]) == (128 + 33, 40 + 11)
    assert (two["total_occupants"], two["max_level_width_mm"], two["total_sprinklers"], two["floors_assessed"]) == (None, None, 13, 1)


def test_scores_of_findings(spark):
    x = spark.createDataFrame([(1, ["high"] * 6), (2, ["medium", "low"]), (3, None)], "id LONG, s ARRAY<STRING>")
    x = x.withColumn("violations", F.transform("s", lambda v: F.struct(v.alias("severity"))))
    assert {r["id"]: (r["score"], r["grade"], r["noc"]) for r in rs.with_score(x).collect()} == {1: (0, "D", "NOT_READY"), 2: (85, "B", "CONDITIONAL"), 3: (100, "A", "READY")}


def test_reasons_of_applicability(spark):
    schema = "label STRING, height_m DOUBLE, area_m2 DOUBLE, building_height DOUBLE, max_area DOUBLE, grp STRING, height_applies BOOLEAN, area_applies BOOLEAN, applicable BOOLEAN"
    rows = [("Business", 15.0, 750.0, 16.0, 800.0, "E", True, True, True), ("Business", 15.0, 750.0, 9.0, 80.0, "E", False, False, False), (None, None, None, 9.0, 80.0, "Z", False, False, False)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(rs.applicability_reason()).collect()]
    assert got == [
        "Building height (16.0m) exceeds 15.0m threshold for Business; Floor area (800.0m²) exceeds 750.0m² threshold for Business",
        "Building height (9.0m) does not exceed 15.0m and floor area (80.0m²) does not exceed 750.0m² for Business occupancy",
        "Occupancy group 'Z' not found in NBCS 2026 applicability table",
    ]
