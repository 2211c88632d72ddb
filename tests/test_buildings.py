"""Golden cases of the building operators."""

import pytest
from pyspark.sql import functions as F

from emberplan.operators import floors as fl
from emberplan.operators import hazard as hz
from emberplan.operators import installs as ins
from emberplan.operators import mixed as mx
from emberplan.operators import result as rs
from emberplan.sources import rules as R

BUILDING = "building_id LONG, floor_areas ARRAY<DOUBLE>, total_floor_area DOUBLE, number_of_floors INT, building_height DOUBLE, occupant_count INT, flammable_gases_litres DOUBLE, flammable_liquids_litres DOUBLE, has_kitchen BOOLEAN, cooking_area_m2 DOUBLE, has_combustible_metals BOOLEAN"


def building(i=1, areas=(100.0,), total=100.0, n=1, height=3.0, occ=5, gas=0.0, liquid=0.0, kitchen=False, cooking=None, metals=False):
    return (i, list(areas), total, n, height, occ, gas, liquid, kitchen, cooking, metals)


@pytest.mark.parametrize(
    ("change", "expected"),
    [({}, "low"), ({"occ": 100}, "moderate"), ({"height": 20.0}, "high"), ({"total": 5000.0}, "high"), ({"occ": 500}, "high"), ({"liquid": 1500.0}, "high"), ({"height": 15.0}, "low"), ({"gas": 500.0}, "moderate"), ({"occ": 250}, "moderate")],
)
def test_hazard(spark, change, expected):
    b = spark.createDataFrame([building(**change)], BUILDING)
    assert hz.with_hazard(b).first()["hazard"] == expected


def test_large_building(spark):
    b = hz.with_hazard(spark.createDataFrame([building(areas=[1250.0] * 4, total=5000.0, n=4, height=16.0, occ=500)], BUILDING))
    got = fl.extinguishers(fl.unnest_floors(b), R.frame(spark, R.CLASS_A)).select("rating", "count").distinct().collect()
    assert [tuple(r) for r in got] == [("4A", 13)]
    f = spark.createDataFrame([(0.06,), (0.25,), (0.6,)], "a DOUBLE")
    assert {r["a"]: (r["rating"], r["count"]) for r in fl.class_f("a", R.frame(spark, R.CLASS_F), f).collect()} == {0.06: ("25F", 1), 0.25: ("75F", 1), 0.6: ("75F", 3)}


def test_violations_and_scores(spark):
    b = spark.createDataFrame([building(1, kitchen=True), building(2, metals=True), building(3), building(4, kitchen=True, cooking=0.05)], BUILDING)
    b = b.withColumn("td_rule", F.lit(None).cast("string")).withColumn("over_height", F.lit(False)).withColumn("violations", rs.findings())
    v = b.select("building_id", F.inline("violations"))
    assert {(r["building_id"], r["rule_id"], r["severity"]) for r in v.collect()} == {(1, "F-MISSING-AREA", "medium"), (2, "D-PROFESSIONAL", "high")}
    assert {r["building_id"]: (r["score"], r["grade"], r["noc"]) for r in rs.with_score(b).collect()} == {1: (90, "A", "READY"), 2: (80, "B", "CONDITIONAL"), 3: (100, "A", "READY"), 4: (100, "A", "READY")}


def test_loads_and_exits(spark):
    f = spark.createDataFrame([(1, 0, 1000.0, "E"), (2, 0, 1000.0, "Z")], "building_id LONG, floor_idx INT, area DOUBLE, grp STRING")
    f = fl.load_factor(f, R.frame(spark, R.LOAD))
    assert [(r["building_id"], r["total_occupants"]) for r in fl.occupant_load(f).collect()] == [(1, 100)]
    e = f.withColumn("stairway_mm", F.lit(10.0)).withColumn("level_mm", F.lit(6.5))
    assert fl.exit_capacity(e).first()["max_stairway_width_mm"] == 1000.0


ROWS = "building_id LONG, grp STRING, subdivision STRING, building_height DOUBLE, tier_area DOUBLE, number_of_floors INT, basement_area DOUBLE"


def install(spark, *rows):
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ROWS)
    return [r.asDict() for r in ins.installations(t, *(R.frame(spark, x) for x in (R.HEIGHT_LIMIT, R.TIERS, R.NOTES))).orderBy("building_id").collect()]


def test_installations(spark):
    e, a2, a5, d6, j, a1, g1, z = install(
        spark, ("E", None, 8.0, 0.0, 0, 0.0), ("A", "A-2", 10.0, 0.0, 0, 0.0), ("A", "A-5", 10.0, 0.0, 0, 0.0), ("D", "D-6", 10.0, 0.0, 0, 0.0), ("J", None, 10.0, 0.0, 0, 0.0), ("A", "A-1", 20.0, 0.0, 0, 0.0), ("G", "G-1", 20.0, 0.0, 0, 0.0), ("Z", None, 9.0, 0.0, 0, 0.0)
    )
    assert (e["fire_extinguisher"], e["first_aid_hose_reel"], e["wet_riser"], e["down_comer"]) == (True, True, False, True) and e["notes"]
    assert not any(a2[f] for f in R.FLAGS)
    assert a5["fire_extinguisher"] and a5["manual_fire_alarm"]
    assert d6["wet_riser"] and d6["automatic_sprinkler"] and d6["underground_tank_litres"] == 200000
    assert all(j[f] for f in R.FLAGS) and j["underground_tank_litres"] is None
    assert a1["over_height"] and a1["tier_label"] is None and g1["over_height"]
    assert z["tier_label"] is None


def test_notes_apply_in_order(spark):
    tiers = spark.createDataFrame([r for r in R.TIERS[1] if r[0] == "E"][:1], R.TIERS[0])
    notes = spark.createDataFrame([("E", 0, 1, "b", "always", "terrace_pump_lpm", 5, None), ("E", 0, 0, "a", "always", "terrace_pump_lpm", None, 10), ("E", 0, 2, "c", "always", "underground_pump_lpm", 7, None), ("E", 0, 3, "d", "never", "wet_riser", None, None)], R.NOTES[0])
    t = spark.createDataFrame([(1, "E", None, 8.0, 0.0, 1, 0.0)], ROWS)
    r = ins.installations(t, R.frame(spark, R.HEIGHT_LIMIT), tiers, notes).first()
    assert (r["terrace_pump_lpm"], r["underground_pump_lpm"], r["wet_riser"]) == (15, 7, False)


def test_tier_bounds(spark):
    low, high, far = install(spark, ("A", "A-4", 15.0, 50.0, 1, 0.0), ("A", "A-4", 15.5, 50.0, 1, 0.0), ("H", None, 9.0, 0.0, 0, 0.0))
    assert low["tier_label"] == "below 15 m"  # adjacent tiers overlap at the bound: the first wins
    assert high["tier_label"] == "15 to 35 m" and far["tier_label"] == "up to 15 m"


def test_travel(spark):
    t = spark.createDataFrame([(1, "E", None, "type12", False, None), (2, "E", None, "type12", True, 40.0), (3, "E", None, "type12", True, 46.0), (4, "H", None, "type34", True, None), (5, "E", None, None, True, 99.0)], "building_id INT, grp STRING, subdivision STRING, construction_type STRING, has_sprinklers BOOLEAN, travel_distance_m DOUBLE")
    got = {r["building_id"]: (r["max_m"], r["td_rule"]) for r in ins.travel(t, R.frame(spark, R.TRAVEL), 1.5).collect()}
    assert got == {1: (30.0, None), 2: (45.0, None), 3: (45.0, "NBC-TD-EXCEED"), 4: (-1.0, "NBC-TD-NOT-PERMITTED"), 5: (None, None)}


def test_strictest_with_ties(spark):
    e = spark.createDataFrame([(1, 0, "A", 5, None, None, None), (1, 1, "B", 9, None, None, 3), (1, 2, "C", 9, None, None, None)], "building_id INT, ordinal INT, code STRING, " + ", ".join(f"{a} INT" for a in R.AMOUNTS))
    got = {r["field"]: (r["value"], r["triggered_by"]) for r in mx.strictest_amounts(e).collect()}
    assert got == {"underground_tank_litres": (9, ["B", "C"]), "terrace_pump_lpm": (3, ["B"])}


def test_confidence(spark):
    b = spark.createDataFrame([building(1, [250.0, 250.0], 500.0, 2, 7.0, 50), building(2, [250.0, 250.0], 0.0, 2, 7.0, 50), building(3, [250.0, 250.0], 500.0, 5, 15.0, 50), building(4, [250.0, 250.0], 500.0, 2, 7.0, 500), building(5, [], 0.0, 0, 0.0, 0)], BUILDING)
    got = {r["building_id"]: r for r in hz.confidence(b).collect()}
    assert (got[1]["score"], got[1]["overall"], got[1]["flags"]) == (100, "high", [])
    assert "area" in got[2]["flags"] and "floor_count" in got[3]["flags"] and "dense" in got[4]["flags"]
    assert got[5]["overall"] == "low"
