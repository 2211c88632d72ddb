"""Rule tables as small DataFrames, each with an explicit ordinal where order has a meaning.

Rows under "fixed values" are the published thresholds. Rows under "authored" stand in for two
tables whose values are not published; they agree with every published check value.
Nothing here grows with data, so that each table is broadcast by its size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# --- Fixed values ---------------------------------------------------------------------------

CLASS_A = ("hazard STRING, rating STRING, max_area DOUBLE", [("low", "2A", 300.0), ("moderate", "3A", 150.0), ("high", "4A", 100.0)])
CLASS_B = ("hazard STRING, rating STRING, max_area DOUBLE", [("low", "55B", 300.0), ("moderate", "144B", 150.0), ("high", "233B", 100.0)])
CLASS_F = ("ordinal INT, above DOUBLE, upto DOUBLE, rating STRING", [(0, -1.0, 0.03, "5F"), (1, 0.03, 0.05, "15F"), (2, 0.05, 0.08, "25F"), (3, 0.08, 0.25, "75F")])
TRAVEL_TO_EXTINGUISHER = (
    "fire_class STRING, hazard STRING, metres DOUBLE",
    [("A", "low", 20.0), ("A", "moderate", 20.0), ("A", "high", 15.0), ("B", None, 15.0), ("C", None, 15.0), ("D", None, 20.0), ("F", None, 10.0)],
)
APPLICABILITY = (
    "key STRING, label STRING, height_m DOUBLE, area_m2 DOUBLE",
    [
        ("A", "Residential", 24.0, 750.0),
        ("B", "Educational", 9.0, 500.0),
        ("C", "Institutional", 15.0, 500.0),
        ("D", "Assembly", 9.0, 750.0),
        ("E", "Business", 15.0, 750.0),
        ("F", "Mercantile", 15.0, 1000.0),
        ("G-1", "Industrial - Low hazard", None, 2000.0),
        ("G-2", "Industrial - Moderate hazard", None, 2000.0),
        ("G-3", "Industrial - High hazard", 15.0, 500.0),
        ("H", "Storage", 9.0, 500.0),
        ("J", "Hazardous", 9.0, 500.0),
        ("MIXED", "Mixed", 15.0, 1000.0),
    ],
)
BUILDING_TYPES = (
    "ordinal INT, building_type STRING, grp STRING, subdivision STRING, nbcs_subdivision STRING",
    [
        (i, *r)
        for i, r in enumerate(
            [
                ("Lodging / Guest House", "A", "A-1", "A-I"),
                ("Private Dwelling (1-2 Family)", "A", "A-2", None),
                ("Dormitory / Hostel", "A", "A-3", "A-II"),
                ("Residential Apartment", "A", "A-4", "A-III"),
                ("Hotel", "A", "A-5", "A-IV"),
                ("Hotel (5-Star+)", "A", "A-6", "A-V"),
                ("School (up to Sr. Secondary)", "B", None, None),
                ("College / University", "B", None, None),
                ("Hospital / Nursing Home", "C", "C-1", "C-I"),
                ("Old Age Home / Orphanage", "C", "C-2", "C-II"),
                ("Jail / Prison", "C", "C-3", "C-III"),
                ("Assembly (Theatre / Hall / Stadium)", "D", None, None),
                ("Multiplex / Entertainment Complex", "D", "D-6", None),
                ("Religious / Exhibition Hall", "D", "D-7", None),
                ("Office / Bank", "E", "E-I", "E-I"),
                ("Laboratory / Library", "E", "E-I", "E-I"),
                ("Data Centre", "E", "E-II", "E-II"),
                ("Small Shop (≤500 m²)", "F", "F-I", "F-I"),
                ("Mall / Department Store", "F", "F-I", "F-I"),
                ("Underground Shopping", "F", "F-II", "F-II"),
                ("Factory (Low Hazard)", "G", "G-1", "G-I"),
                ("Factory (Moderate Hazard)", "G", "G-2", "G-II"),
                ("Factory (High Hazard)", "G", "G-3", "G-III"),
                ("Warehouse / Storage", "H", None, None),
                ("Multi-Level Car Parking", "H", "MLCP", None),
                ("Hazardous Storage", "J", None, None),
                ("Mixed Use Building", "K", "K", "K"),
            ]
        )
    ],
)
#: Square metres a person: (group, subdivision or "default", net, gross). A group without any match has none.
NBCS_LOAD = (
    "grp STRING, sub STRING, net DOUBLE, gross DOUBLE",
    [
        ("A", "default", 12.5, None),
        ("B", "default", 3.0, None),
        ("C", "default", None, 12.0),
        ("D", "default", 1.4, None),
        ("E", "default", 7.1, None),
        ("E", "E-II", None, 20.0),
        ("F", "default", None, 2.1),
        ("G", "G-I", None, 20.0),
        ("G", "G-II", None, 15.0),
        ("G", "G-III", None, 10.0),
        ("H", "default", None, 30.0),
        ("J", "default", None, 10.0),
        ("K", "default", None, 10.0),
    ],
)
NBCS_EXIT = (
    "grp STRING, stairway_mm DOUBLE, level_mm DOUBLE, dead_end_m DOUBLE",
    [(g, 15.0 if g == "C" else 18.0 if g == "J" else 10.0, 13.0 if g == "C" else 10.0 if g == "J" else 6.5, 6.0 if g in "BCD" else 15.0) for g in "ABCDEFGHJK"],
)
#: Sprinklered, construction 1 and 2. Group G has no row of its own and so no distance.
NBCS_TRAVEL = (
    "key STRING, metres DOUBLE",
    [("A", 60.0), ("B", 45.0), ("C", 45.0), ("D", 45.0), ("E", 60.0), ("E-II", 60.0), ("F", 45.0), ("H", 90.0), ("J", 30.0), ("K", 45.0)],
)
SYSTEMS = (
    "ordinal INT, id STRING, title STRING, field STRING, clause STRING, standards ARRAY<STRING>, steps INT",
    [
        (0, "fire_extinguisher", "Fire Extinguisher", "fire_extinguisher", "NBC 2016 Part 4, Table 7", ["IS 2190"], 2),
        (1, "hose_reel", "First-aid Hose Reel", "first_aid_hose_reel", "NBC 2016 Part 4, Table 7", ["IS 884", "IS 3844"], 2),
        (2, "wet_riser", "Wet Riser", "wet_riser", "NBC 2016 Part 4, Table 7 (Cols. wet riser)", ["IS 3844", "IS 15301"], 3),
        (3, "down_comer", "Down Comer", "down_comer", "NBC 2016 Part 4, Table 7 (Cols. down comer)", ["IS 3844"], 3),
        (4, "yard_hydrant", "Yard Hydrant", "yard_hydrant", "NBC 2016 Part 4, Table 7", ["IS 908", "IS 13039", "IS 5290"], 2),
        (5, "sprinkler_system", "Sprinkler System", "automatic_sprinkler", "NBC 2016 Part 4, Table 7", ["IS 15105", "IS 9972"], 2),
        (6, "manual_alarm", "Manual Fire Alarm", "manual_fire_alarm", "NBC 2016 Part 4, Table 7", ["IS 2189"], 2),
        (7, "auto_detection", "Automatic Detection & Alarm", "auto_detection_alarm", "NBC 2016 Part 4, Table 7", ["IS 2189", "IS 15908"], 2),
    ],
)
STANDARD_TRIGGERS = (
    "standard STRING, triggers ARRAY<STRING>",
    [
        ("IS 2190", ["fire_extinguisher"]),
        ("IS 884", ["hose_reel"]),
        ("IS 3844", ["wet_riser", "down_comer", "hose_reel"]),
        ("IS 908", ["yard_hydrant"]),
        ("IS 13039", ["yard_hydrant"]),
        ("IS 5290", ["yard_hydrant", "wet_riser"]),
        ("IS 9668", ["underground_tank_litres", "terrace_tank_litres"]),
        ("IS 15301", ["underground_pump_lpm", "terrace_pump_lpm", "wet_riser"]),
        ("IS 15105", ["sprinkler_system"]),
        ("IS 9972", ["sprinkler_system"]),
        ("IS 2189", ["manual_alarm", "auto_detection"]),
        ("IS 15908", ["auto_detection"]),
    ],
)
PRESETS = (
    "ordinal INT, preset STRING, occupancies ARRAY<STRING>",
    [
        (0, "Retail below homes", ["F-1", "A-4"]),
        (1, "Offices above shops", ["E-1", "F-1"]),
        (2, "Hotel with hall", ["A-5", "D-6"]),
        (3, "Clinic and laboratory", ["C-1", "E-2"]),
        (4, "Works with store", ["G-2", "H"]),
    ],
)
FLAGS = ["fire_extinguisher", "first_aid_hose_reel", "wet_riser", "down_comer", "yard_hydrant", "automatic_sprinkler", "manual_fire_alarm", "auto_detection_alarm"]
AMOUNTS = ["underground_tank_litres", "terrace_tank_litres", "underground_pump_lpm", "terrace_pump_lpm"]

# --- Authored -------------------------------------------------------------------------------

LOAD = (
    "grp STRING, sub_type STRING, ordinal INT, factor DOUBLE",
    [
        ("A", "default", 0, 12.5),
        ("B", "default", 0, 4.0),
        ("C", "indoor", 0, 15.0),
        ("C", "outdoor", 1, 10.0),
        ("D", "concentrated", 0, 0.65),
        ("D", "default", 1, 1.5),
        ("E", "default", 0, 10.0),
        ("F", "street", 0, 3.0),
        ("F", "upper", 1, 6.0),
        ("G", "default", 0, 10.0),
        ("H", "default", 0, 30.0),
        ("J", "default", 0, 10.0),
        ("K", "default", 0, 10.0),
    ],
)
EXIT = ("grp STRING, stairway_mm DOUBLE, level_mm DOUBLE", [(g, 15.0 if g == "C" else 18.0 if g == "J" else 10.0, 13.0 if g == "C" else 10.0 if g == "J" else 6.5) for g in "ABCDEFGHJK"])
EXIT_MIN_MM = 1000.0
#: A null distance is "not permitted".
TRAVEL = (
    "key STRING, type12 DOUBLE, type34 DOUBLE",
    [("A", 30.0, 22.5), ("B", 30.0, 22.5), ("C", 30.0, 22.5), ("D", 30.0, 30.0), ("E", 30.0, 30.0), ("F", 30.0, 30.0), ("G-1", 45.0, None), ("G-2", 45.0, None), ("G-3", 22.5, None), ("H", 30.0, None), ("J", 22.5, None), ("K", 30.0, 22.5)],
)
SPRINKLER_BONUS = 1.5
HEIGHT_LIMIT = ("key STRING, max_height DOUBLE", [("A-1", 15.0), ("G-1", 18.0), ("J", 18.0)])

_TIER_COLS = "key STRING, tier_idx INT, label STRING, min_height DOUBLE, max_height DOUBLE, min_area DOUBLE, max_area DOUBLE, min_floors INT, max_floors INT, " + ", ".join(f"{f} BOOLEAN" for f in FLAGS) + ", " + ", ".join(f"{a} INT" for a in AMOUNTS)
_HIGH = 9999.0


def _tier(key, i, label, flags, max_height=_HIGH, min_height=None, max_area=None, min_area=None, max_floors=None, min_floors=None, amounts=(None, None, None, None)):
    return (key, i, label, min_height, max_height, min_area, max_area, min_floors, max_floors, *[c == "1" for c in flags], *amounts)


# Flags in the order of FLAGS: extinguisher, reel, riser, down comer, yard, sprinkler, manual, detection.
TIERS = (
    _TIER_COLS,
    [
        _tier("A-1", 0, "below 15 m, up to 300 m2", "11000010", 15.0, max_area=300.0, amounts=(None, 5000, None, None)),
        _tier("A-1", 1, "below 15 m, above 300 m2", "11000011", 15.0, min_area=300.0, amounts=(None, 10000, None, 450)),
        _tier("A-2", 0, "up to 15 m", "00000000", 15.0),
        _tier("A-2", 1, "15 to 24 m", "11010010", 24.0, min_height=15.0, amounts=(None, 5000, None, 450)),
        _tier("A-2", 2, "above 24 m", "11100010", min_height=24.0, amounts=(50000, 10000, 1620, None)),
        _tier("A-4", 0, "below 15 m", "10000000", 15.0),
        _tier("A-4", 1, "15 to 35 m", "11010010", 35.0, min_height=15.0, amounts=(None, 25000, None, 900)),
        _tier("A-4", 2, "35 m and above", "11100111", min_height=35.0, amounts=(75000, 10000, 2280, None)),
        _tier("A-5", 0, "up to 15 m, few floors", "10000010", 15.0, max_floors=3),
        _tier("A-5", 1, "up to 15 m, more floors", "11010010", 15.0, min_floors=3, amounts=(None, 10000, None, 450)),
        _tier("A-5", 2, "above 15 m", "11101111", min_height=15.0, amounts=(150000, 20000, 2280, 900)),
        _tier("A", 0, "up to 15 m", "11000010", 15.0, amounts=(None, 5000, None, None)),
        _tier("A", 1, "above 15 m", "11100111", min_height=15.0, amounts=(100000, 10000, 2280, None)),
        _tier("B", 0, "up to 15 m", "11000010", 15.0, max_area=1000.0, amounts=(None, 10000, None, 450)),
        _tier("B", 1, "above 15 m or larger", "11110011", amounts=(50000, 10000, 1620, 450)),
        _tier("C-1", 0, "up to 15 m, up to 1000 m2", "11010010", 15.0, max_area=1000.0, amounts=(None, 10000, None, 450)),
        _tier("C-1", 1, "up to 15 m, larger", "11110111", 15.0, min_area=1000.0, amounts=(100000, 10000, 2280, None)),
        _tier("C-1", 2, "above 15 m", "11101111", min_height=15.0, amounts=(200000, 20000, 2850, 900)),
        _tier("C", 0, "any height", "11100111", amounts=(100000, 10000, 2280, None)),
        _tier("D", 0, "up to 10 m", "11000010", 10.0, amounts=(None, 10000, None, 450)),
        _tier("D", 1, "above 10 m", "11101111", min_height=10.0, amounts=(150000, 10000, 2280, None)),
        _tier("D-6", 0, "any height", "11101111", amounts=(200000, 20000, 2850, 450)),
        _tier("E", 0, "up to 15 m", "11010010", 15.0, amounts=(None, 10000, None, 450)),
        _tier("E", 1, "15 to 24 m", "11100011", 24.0, min_height=15.0, amounts=(75000, 10000, 2280, None)),
        _tier("E", 2, "above 24 m", "11101111", min_height=24.0, amounts=(150000, 20000, 2850, 900)),
        _tier("F", 0, "up to 15 m, up to 2 floors", "11000010", 15.0, max_floors=2, amounts=(None, 5000, None, 450)),
        _tier("F", 1, "up to 15 m, more floors", "11010110", 15.0, min_floors=3, amounts=(None, 10000, None, 900)),
        _tier("F", 2, "above 15 m", "11101111", min_height=15.0, amounts=(150000, 10000, 2280, None)),
        _tier("G-1", 0, "up to 100 m2", "10000000", max_area=100.0),
        _tier("G-1", 1, "100 to 500 m2", "11000010", min_area=100.0, max_area=500.0, amounts=(None, 5000, None, 450)),
        _tier("G-1", 2, "above 500 m2", "11001011", min_area=500.0, amounts=(50000, 5000, 1620, None)),
        _tier("G", 0, "any height", "11101111", amounts=(100000, 10000, 2280, None)),
        _tier("H", 0, "up to 15 m", "11000010", 15.0, amounts=(None, 10000, None, 450)),
        _tier("H", 1, "above 15 m", "11101111", min_height=15.0, amounts=(100000, 10000, 2280, None)),
        _tier("J", 0, "up to 18 m", "11111111", 18.0),
        _tier("K", 0, "any height", "11101111", amounts=(150000, 10000, 2280, None)),
    ],
)
#: Notes of a tier apply in order: set, add, or force the field's flag.
NOTES = (
    "key STRING, tier_idx INT, note_idx INT, note_id STRING, cond STRING, field STRING, additional INT, set_value INT",
    [
        ("E", 0, 0, "4", "basement_area_gt_200", "automatic_sprinkler", None, None),
        ("E", 0, 1, "6", "basement_area_gt_200", "terrace_tank_litres", 5000, None),
        ("E", 0, 2, "10", "floors_gt_2", "terrace_pump_lpm", None, 900),
        ("E", 1, 0, "4", "basement_area_gt_200", "automatic_sprinkler", None, None),
        ("E", 1, 1, "11", "always", "terrace_pump_lpm", None, 450),
        ("E", 2, 0, "12", "height_gte_60", "underground_pump_lpm", None, 4540),
        ("A-4", 1, 0, "6", "basement_area_gt_200", "terrace_tank_litres", 5000, None),
        ("A-4", 1, 1, "14", "floors_gt_1", "terrace_pump_lpm", None, 450),
        ("A-4", 1, 2, "6", "always", "terrace_pump_lpm", 90, None),
        ("A-2", 0, 0, "3", "floors_gt_2", "fire_extinguisher", None, None),
        ("C-1", 0, 0, "4", "basement_area_gt_200", "automatic_sprinkler", None, None),
        ("C-1", 1, 0, "10", "height_gte_15", "underground_pump_lpm", None, 2850),
        ("F", 0, 0, "6", "basement_area_gt_200", "terrace_tank_litres", 5000, None),
        ("F", 0, 1, "6", "floors_gt_1", "underground_tank_litres", 25000, None),
        ("F", 1, 0, "9", "unknown_condition", "wet_riser", None, None),
        ("B", 1, 0, "4", "basement_area_gt_200", "automatic_sprinkler", None, None),
        ("D-6", 0, 0, "12", "floors_gt_2", "terrace_pump_lpm", 450, None),
        ("G-1", 1, 0, "4", "basement_area_gt_200", "automatic_sprinkler", None, None),
    ],
)
_NBCS = ["fire_extinguisher", "first_aid_hose_reel", "wet_riser", "down_comer", "yard_hydrant", "automatic_sprinkler", "auto_detection_alarm", "public_address"]
#: A null flag is one that the table does not name.
NBCS_TIERS = (
    "grp STRING, sub STRING, tier_idx INT, min_height DOUBLE, max_height DOUBLE, min_area DOUBLE, max_area DOUBLE, level STRING, self_area DOUBLE, self_height DOUBLE, " + ", ".join(f"{f} BOOLEAN" for f in _NBCS),
    [
        (g, s, i, lo, hi, alo, ahi, level, sa, sh, *[None if c == "-" else c == "1" for c in flags])
        for g, s, i, lo, hi, alo, ahi, level, sa, sh, flags in [
            ("A", "A-I", 0, None, 15.0, None, None, "HL-1", 300.0, 9.0, "110000-0"),
            ("A", "A-I", 1, 15.0, 24.0, None, None, "HL-2", 300.0, 9.0, "11000010"),
            ("A", "A-II", 0, None, 15.0, None, 500.0, "HL-1", 300.0, 9.0, "110-0000"),
            ("A", "A-II", 1, None, None, None, None, "CL-3", 300.0, 9.0, "11101111"),
            ("A", "A-III", 0, None, 15.0, None, None, "HL-1", None, None, "10000000"),
            ("A", "A-III", 1, 15.0, None, None, None, "CL-4", None, None, "11100110"),
            ("A", "A-IV", 0, None, 24.0, None, 400.0, "CL-1", 250.0, 12.0, "11010011"),
            ("C", "C-I", 0, None, None, None, 300.0, "CL-2", 200.0, 9.0, "11100011"),
            ("C", "C-I", 1, None, None, 300.0, None, "CL-5", 200.0, 9.0, "11101111"),
            ("E", "E-I", 0, None, 15.0, None, None, "HL-2", 300.0, 9.0, "11010010"),
            ("E", "E-I", 1, 15.0, None, None, None, "CL-3", 300.0, 9.0, "11101111"),
            ("E", "E-II", 0, None, None, None, None, None, None, None, "11-01111"),
            ("F", "F-I", 0, None, 15.0, None, 350.0, "CL-1", 200.0, 9.0, "11000010"),
            ("F", "F-I", 1, None, None, None, None, "CL-4", 200.0, 9.0, "11101111"),
            ("G", "G-I", 0, None, None, None, None, "CL-2", 400.0, 18.0, "11001010"),
            ("K", "K", 0, None, None, None, None, "CL-5", None, None, "11101111"),
        ]
    ],
)
NBCS_FLAGS = _NBCS


def frame(spark: SparkSession, table: tuple[str, list]) -> DataFrame:
    """A rule table as a local relation: its size is known to the optimiser and no job reads it."""
    schema, rows = table
    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields))


# --- The same tables for the DuckDB side ----------------------------------------------------


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def system_rows() -> list[dict]:
    """The systems as rows, for operators that turn them into expressions."""
    names = [f.split()[0] for f in SYSTEMS[0].split(", ")]
    return [dict(zip(names, row, strict=True)) for row in SYSTEMS[1]]


def cte(name: str, table: tuple[str, list]) -> str:
    """A common table expression with the table's rows and types."""
    schema, rows = table
    cols = [c.rsplit(" ", 1) for c in schema.split(", ")]
    types = [{"STRING": "VARCHAR", "INT": "INTEGER", "ARRAY<STRING>": "VARCHAR[]"}.get(t, t) for _, t in cols]
    select = ", ".join(f"CAST({c} AS {t}) AS {c}" for (c, _), t in zip(cols, types, strict=True))
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"{name} AS (SELECT {select} FROM (VALUES {values}) AS t({', '.join(c for c, _ in cols)}))"
