"""The engine's inputs projected from the driver's tables, and the same projections in SQL.

An order is a building and its lines are floors. Line numbers repeat within an order, so
floors are ordered by more columns, which together are unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLOOR_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(building_id, floor_idx, area, part, supplier): a window over an order's few lines."""
    w = Window.partitionBy("l_orderkey").orderBy(*FLOOR_ORDER)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("building_id"),
        (F.row_number().over(w) - 1).cast("int").alias("floor_idx"),
        (F.col("l_quantity") * 8).alias("area"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
    )


FLOORS = """floors AS (
  SELECT l_orderkey AS building_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS floor_idx,
         l_quantity * 8 AS area, l_partkey AS part, l_suppkey AS supplier FROM lineitem)"""


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each building: one aggregation by order, then a join with orders by key."""
    line = table(spark, sf_dir, "lineitem")
    place = F.struct(*FLOOR_ORDER, (F.col("l_quantity") * 8).alias("area"))
    agg = line.groupBy(F.col("l_orderkey").alias("building_id")).agg(
        F.transform(F.array_sort(F.collect_list(place)), lambda x: x["area"]).alias("floor_areas"),
        F.sum(F.col("l_quantity") * 8).alias("total_floor_area"),
        F.count("*").cast("int").alias("number_of_floors"),
        F.bool_or(F.col("l_returnflag") == "R").alias("has_kitchen"),
        F.bool_or(F.col("l_linestatus") == "O").alias("has_electrical_hazards"),
        F.sum("l_suppkey").alias("suppliers"),
        F.sum("l_partkey").alias("parts"),
    )
    orders = table(spark, sf_dir, "orders")
    b = agg.join(orders, F.col("building_id") == F.col("o_orderkey"))
    key = F.col("building_id")
    priority = F.substring("o_orderpriority", 1, 1)
    return b.select(
        "building_id",
        "floor_areas",
        "total_floor_area",
        "number_of_floors",
        (F.lit(3.5) * F.col("number_of_floors")).alias("building_height"),
        F.floor(F.col("total_floor_area") / 10).cast("int").alias("occupant_count"),
        ((key % 5) * 100).cast("double").alias("basement_area"),
        (key % 3).cast("int").alias("basement_count"),
        "has_kitchen",
        F.when(key % 7 > 0, (key % 7) * F.lit(0.05)).alias("cooking_area_m2"),
        ((F.col("suppliers") * 7) % 1500).cast("double").alias("flammable_liquids_litres"),
        ((F.col("suppliers") * 7) % 1500 > 700).alias("has_flammable_liquids"),
        (F.col("parts") % 3500).cast("double").alias("flammable_gases_litres"),
        (F.col("parts") % 11 == 0).alias("has_combustible_metals"),
        "has_electrical_hazards",
        (F.col("parts") % 6 == 0).alias("has_ev_parking"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("has_sprinklers"),
        F.when(priority.isin("1", "2"), "type12").when(priority.isin("3", "4"), "type34").alias("construction_type"),
        F.when(key % 9 > 0, ((key % 9) * 10).cast("double")).alias("travel_distance_m"),
        (key % 27).cast("int").alias("type_ordinal"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("priority"),
    )


BUILDINGS = """bagg AS (
  SELECT l_orderkey AS building_id, list(l_quantity * 8 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS floor_areas,
         sum(l_quantity * 8) AS total_floor_area, CAST(count(*) AS INTEGER) AS number_of_floors, bool_or(l_returnflag = 'R') AS has_kitchen,
         bool_or(l_linestatus = 'O') AS has_electrical_hazards, CAST(sum(l_suppkey) AS BIGINT) AS suppliers, CAST(sum(l_partkey) AS BIGINT) AS parts
  FROM lineitem GROUP BY l_orderkey),
buildings AS (
  SELECT building_id, floor_areas, total_floor_area, number_of_floors, CAST(3.5 * number_of_floors AS DOUBLE) AS building_height,
         CAST(floor(total_floor_area / 10) AS INTEGER) AS occupant_count, CAST(building_id % 5 * 100 AS DOUBLE) AS basement_area, CAST(building_id % 3 AS INTEGER) AS basement_count,
         has_kitchen, CASE WHEN building_id % 7 > 0 THEN CAST(building_id % 7 AS DOUBLE) * CAST(0.05 AS DOUBLE) END AS cooking_area_m2,
         CAST(suppliers * 7 % 1500 AS DOUBLE) AS flammable_liquids_litres, suppliers * 7 % 1500 > 700 AS has_flammable_liquids,
         CAST(parts % 3500 AS DOUBLE) AS flammable_gases_litres, parts % 11 = 0 AS has_combustible_metals, has_electrical_hazards, parts % 6 = 0 AS has_ev_parking,
         CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS has_sprinklers,
         CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'type12' WHEN o_orderpriority[1] IN ('3', '4') THEN 'type34' END AS construction_type,
         CASE WHEN building_id % 9 > 0 THEN CAST(building_id % 9 * 10 AS DOUBLE) END AS travel_distance_m,
         CAST(building_id % 27 AS INTEGER) AS type_ordinal, o_custkey AS customer, o_orderpriority AS priority
  FROM bagg JOIN orders ON building_id = o_orderkey)"""

# The occupancy of a part's kind and of an order's priority: fixed bindings.
PART_OCCUPANCY = {"ECONOMY": "A-4", "LARGE": "E-1", "MEDIUM": "F-1", "PROMO": "D-6", "SMALL": "A-2", "STANDARD": "C-1"}
PRIORITY_OCCUPANCY = {"1-URGENT": "A-5", "2-HIGH": "C-1", "3-MEDIUM": "E-1", "4-NOT SPECIFIED": "G-1", "5-LOW": "B"}


def _choose(col, choices: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in choices.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def _case(col: str, choices: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in choices.items()) + " END"


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(building_id, floor_idx, occupancy_code, area_m2): a floor's part gives its occupancy.

    part is as large as it likes: the join is left to its size.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", _choose(F.substring_index("p_type", " ", 1), PART_OCCUPANCY).alias("occupancy_code"))
    f = floors(spark, sf_dir)
    return f.join(parts, f["part"] == parts["p_partkey"]).where("occupancy_code is not null").select("building_id", "floor_idx", "occupancy_code", F.col("area").alias("area_m2"))


ZONES = f"""zones AS (
  SELECT building_id, floor_idx, {_case("split_part(p_type, ' ', 1)", PART_OCCUPANCY)} AS occupancy_code, area AS area_m2
  FROM floors JOIN part ON part = p_partkey WHERE {_case("split_part(p_type, ' ', 1)", PART_OCCUPANCY)} IS NOT NULL)"""


def primary_occupancy():
    return _choose(F.col("priority"), PRIORITY_OCCUPANCY)


PRIMARY = _case("priority", PRIORITY_OCCUPANCY)


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): drawing text written from a part's columns, with gaps and decoys."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(DRAWING_TEXT_SPARK).alias("text"))


def _drawing(cat: str) -> str:
    """The text in SQL that both engines read alike."""
    k = "p_partkey"
    lines = [
        f"CASE {k} % 4 WHEN 0 THEN 'BUILDING HEIGHT = ' WHEN 1 THEN 'Total Ht. : ' WHEN 2 THEN 'MARK ' ELSE 'HEIGHT = 900' END",
        f"CASE {k} % 4 WHEN 3 THEN ' m ' ELSE cast(p_size AS varchar(9)) END",
        f"CASE {k} % 4 WHEN 2 THEN ' m HT' ELSE ' m' END",
        f"CASE {k} % 5 WHEN 0 THEN '\nNO. OF FLOORS = ' || cast(p_size % 9 + 1 AS varchar(9)) WHEN 1 THEN '\nG+' || cast(p_size % 7 + 1 AS varchar(9)) WHEN 2 THEN '\n' || cast(p_size % 300 AS varchar(9)) || ' STOREYS' ELSE '' END",
        f"CASE {k} % 3 WHEN 0 THEN '\nFLOOR AREA = ' || cast(p_size * 9 AS varchar(9)) || ' sqm' WHEN 1 THEN '\n' || cast(p_size * 5 AS varchar(9)) || ' sq.m' ELSE '' END",
        f"CASE {k} % 6 WHEN 0 THEN '\nBASEMENT AREA = ' || cast(p_size * 7 AS varchar(9)) || ' sqm\n1 BASEMENT LEVEL' WHEN 1 THEN '\nBASEMENT = 2' ELSE '' END",
        f"CASE {k} % 7 WHEN 0 THEN '\nSCALE 1:' || cast(p_size + 50 AS varchar(9)) WHEN 1 THEN '\n1 CM = 2.50 MT' WHEN 2 THEN '\nSCALE = 1:100 KEY PLAN SCALE = 1:500' WHEN 3 THEN '\nDO NOT SCALE THE DRAWING' ELSE '' END",
        f"CASE {k} % 8 WHEN 0 THEN '\nRCC framed hotel' WHEN 1 THEN '\ntimber workshop' WHEN 2 THEN '\nDepartment of ' || p_name ELSE '' END",
        f"CASE {k} % 9 WHEN 0 THEN '\nKITCHEN' WHEN 1 THEN '\nSPRINKLER SYSTEM PROPOSED' WHEN 2 THEN '\nPROJECT: Tower ' || p_brand WHEN 3 THEN '\nNOTES: all dimensions are in mm' ELSE '' END",
        f"CASE {k} % 10 WHEN 0 THEN '\nPune, Maharashtra' WHEN 1 THEN '\nDelhi' WHEN 2 THEN '\nGround  Floor, bed room 3500 mm, F 2' ELSE '' END",
    ]
    return " || ".join(f"({x})" for x in lines)


DRAWING_TEXT_SPARK = _drawing("")
DRAWINGS = f"drawings AS (SELECT p_partkey AS doc_id, {_drawing('')} AS text FROM part)"
