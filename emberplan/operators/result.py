"""A building's whole evaluation as one row.

Requirements, findings, passed checks and the score are arrays and folds over the building's own
row, so nothing is shuffled once the buildings are made; child tables are these arrays inlined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import messages as M
from .floors import class_f, floor_label
from .hazard import bands

SMALL = 100.0  # fixed value: floors below this many m2 need one extinguisher, others two


def _listed(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _text(c: str) -> Column:
    """A number's text. Java writes what is 10 million or more with an exponent."""
    x = F.col(c)
    return F.when(F.abs(x) < 1e7, x.cast("string")).otherwise(F.format_string("%.1f", x.cast("double")))


def floor_list() -> Column:
    """The floors' areas, or the total as the one floor where none is known."""
    areas = F.coalesce("floor_areas", F.array().cast("array<double>"))
    return F.when(F.size(areas) > 0, areas).otherwise(F.array("total_floor_area"))


def with_floor_figures(b: DataFrame, least_mm: float, sprinkler_m: float = 2.8, smoke_m: float = 5.0) -> DataFrame:
    """Adds total_occupants, max_occupants, widths and device counts.

    b has load_factor, stairway_mm and level_mm; what depends on a missing one of them is null.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)
    b = b.withColumn("_areas", floor_list())
    b = b.withColumn("_persons", F.transform("_areas", lambda a: F.floor(a / F.col("load_factor"))))
    wide = lambda mm: F.when(F.col("load_factor").isNotNull() & F.col(mm).isNotNull(), F.bround(F.greatest(F.array_max("_persons") * F.col(mm), F.lit(least_mm)), 1))
    devices = lambda m: total(F.transform("_areas", lambda a: F.ceil(a / F.lit(m * m))))
    return b.select(
        "*",
        F.size("_areas").alias("floors_assessed"),
        total("_persons").alias("total_occupants"),
        F.array_max("_persons").alias("max_occupants"),
        wide("stairway_mm").alias("max_stairway_width_mm"),
        wide("level_mm").alias("max_level_width_mm"),
        devices(sprinkler_m).alias("total_sprinklers"),
        devices(smoke_m).alias("total_smoke_detectors"),
    ).drop("_areas", "_persons")


def findings() -> Column:
    """ARRAY<STRUCT<stage, rule_id, severity, clause_ref>> in stage order.

    Needs has_kitchen, cooking_area_m2, has_combustible_metals, td_rule and over_height.
    """

    def found(on: Column, stage: int, rule: str, severity: str) -> Column:
        return F.when(on, F.struct(F.lit(stage).alias("stage"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(M.CLAUSES[rule]).alias("clause_ref")))

    return _listed(
        found(F.col("has_kitchen") & (F.coalesce("cooking_area_m2", F.lit(0)) <= 0), 4, "F-MISSING-AREA", "medium"),
        found(F.col("has_combustible_metals"), 6, "D-PROFESSIONAL", "high"),
        found(F.col("td_rule") == "NBC-TD-NOT-PERMITTED", 7, "NBC-TD-NOT-PERMITTED", "high"),
        found(F.col("td_rule") == "NBC-TD-EXCEED", 7, "NBC-TD-EXCEED", "high"),
        found(F.col("over_height"), 8, "NBC-FI-HEIGHT-NOT-PERMITTED", "high"),
    )


def with_score(b: DataFrame, found: str = "violations") -> DataFrame:
    """Adds score, grade and noc of an array of findings; missing or empty: 100."""
    lost = F.aggregate(F.coalesce(F.transform(found, lambda x: F.when(x["severity"] == "high", 20).when(x["severity"] == "medium", 10).otherwise(5)), F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x)
    b = b.withColumn("score", F.greatest(F.lit(0), 100 - lost))
    grade, noc = bands(F.col("score"))
    return b.withColumn("grade", grade).withColumn("noc", noc)


def with_requirements(b: DataFrame, class_a: DataFrame, class_b: DataFrame, kitchen_bands: DataFrame) -> DataFrame:
    """Adds required: ARRAY<STRUCT<fire_class, floor_label, rating, count>>, in the order A by
    floor, B by floor, F, C. Buildings without known floors have none of A and B."""

    def rated(rows: DataFrame, rules: DataFrame, name: str) -> DataFrame:
        r = rules.select(F.col("hazard").alias("_h"), F.col("rating").alias(f"_{name}_rating"), F.col("max_area").alias(f"_{name}_area"))
        return rows.join(F.broadcast(r), F.col("hazard") == F.col("_h"), "left").drop("_h")  # a row for each hazard

    def by_floor(fire_class: str, name: str) -> Column:
        def one(area, i):
            count = F.greatest(F.ceil(area / F.col(f"_{name}_area")), F.when(area < SMALL, 1).otherwise(2))
            return F.struct(F.lit(fire_class).alias("fire_class"), floor_label(i).alias("floor_label"), F.col(f"_{name}_rating").alias("rating"), count.cast("long").alias("count"))

        return F.transform(F.coalesce("floor_areas", F.array().cast("array<double>")), one)

    def one(fire_class: str, rating: Column, count: Column) -> Column:
        return F.array(F.struct(F.lit(fire_class).alias("fire_class"), F.lit(None).cast("string").alias("floor_label"), rating.alias("rating"), count.cast("long").alias("count")))

    b = class_f("cooking_area_m2", kitchen_bands, rated(rated(b, class_a, "a"), class_b, "b"))
    b = b.withColumnRenamed("rating", "_f_rating").withColumnRenamed("count", "_f_count")
    none = F.array().cast("array<struct<fire_class: string, floor_label: string, rating: string, count: bigint>>")
    b = b.withColumn("required", F.concat(
        by_floor("A", "a"),
        F.when(F.col("has_flammable_liquids"), by_floor("B", "b")).otherwise(none),
        F.when(F.col("has_kitchen") & (F.col("cooking_area_m2") > 0), one("F", F.col("_f_rating"), F.col("_f_count"))).otherwise(none),
        F.when(F.col("has_electrical_hazards"), one("C", F.lit("CO2-2kg"), F.lit(1))).otherwise(none),
    ))
    return b.drop("_a_rating", "_a_area", "_b_rating", "_b_area", "_f_rating", "_f_count")


def applicability_reason() -> Column:
    """Why the second layer applies or does not; needs label, height_m, area_m2 and the two flags."""
    height = F.when(F.col("height_m").isNull(), F.lit(M.ANY_HEIGHT)).otherwise(F.format_string(M.ABOVE_HEIGHT, _text("building_height"), _text("height_m"), "label"))
    area = F.format_string(M.ABOVE_AREA, _text("max_area"), _text("area_m2"), "label")
    both = F.concat_ws("; ", F.when(F.col("height_applies"), height), F.when(F.col("area_applies"), area))
    below = F.format_string(M.BELOW_BOTH, _text("building_height"), _text("height_m"), _text("max_area"), _text("area_m2"), "label")
    return F.when(F.col("label").isNull(), F.format_string(M.NO_THRESHOLD, "grp")).when(F.col("applicable"), both).otherwise(below)


def passed_checks() -> Column:
    """ARRAY<STRUCT<ordinal, message>> of the checks that passed, in order."""

    def said(on: Column, ordinal: int, text: Column) -> Column:
        return F.when(on, F.struct(F.lit(ordinal).alias("ordinal"), text.alias("message")))

    sprinklered = F.when((F.col("base_m") > 0) & F.coalesce("has_sprinklers", F.lit(False)), F.lit(M.SPRINKLERED)).otherwise("")
    walked = F.coalesce("travel_distance_m", F.lit(0.0)) != 0
    distance = F.when(walked, F.format_string(M.TRAVEL_WITHIN, _text("travel_distance_m"), _text("max_m"))).otherwise(F.format_string(M.TRAVEL_ALLOWED, _text("max_m")))
    devices = F.concat_ws(", ", *[F.when(F.col(f), F.lit(t)) for f, t in M.DEVICES.items()])
    return _listed(
        said(F.lit(True), 1, F.format_string(M.CLASS_A, F.size(F.coalesce("floor_areas", F.array().cast("array<double>"))).cast("string"))),
        said(F.col("has_flammable_liquids"), 2, F.lit(M.CLASS_B)),
        said(F.col("has_kitchen") & (F.col("cooking_area_m2") > 0), 3, F.lit(M.CLASS_F)),
        said(F.col("has_electrical_hazards"), 4, F.lit(M.ELECTRICAL)),
        said(F.col("load_factor").isNotNull(), 5, F.format_string(M.LOAD, F.col("total_occupants").cast("string"), F.col("floors_assessed").cast("string"), "grp", _text("load_factor"), F.col("max_occupants").cast("string"))),
        said(F.col("max_level_width_mm").isNotNull(), 6, F.format_string(M.EXITS, _text("stairway_mm"), _text("level_mm"), _text("max_stairway_width_mm"), _text("max_level_width_mm"))),
        said(F.col("max_m").isNotNull() & F.col("td_rule").isNull(), 7, F.format_string(M.TRAVEL, distance, "grp", "construction_type", sprinklered)),
        said(F.col("tier_label").isNotNull() & (F.col("building_height") > 0), 8, F.format_string(M.INSTALLED, "tier_label", devices)),
        said(F.lit(True), 9, F.format_string(M.DETECTORS, F.col("total_sprinklers").cast("string"), F.col("total_smoke_detectors").cast("string"))),
        said(F.lit(True), 10, F.when(F.col("applicable"), F.format_string(M.APPLIES, applicability_reason())).otherwise(F.format_string(M.APPLIES_NOT, applicability_reason()))),
    )
