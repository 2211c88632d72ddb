"""Per-floor counts: labels, occupant loads, exit widths, devices, extinguishers.

Every function takes floors (building_id, floor_idx, area, and what it says) and groups them by
building once; rule tables are joined by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_label(idx) -> Column:
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.when(idx == 0, "Ground Floor").otherwise(F.concat(F.lit("Floor "), idx.cast("string")))


def unnest_floors(buildings: DataFrame, fallback: bool = False) -> DataFrame:
    """A row for each floor area with its place; an empty list gives the total if fallback is set."""
    areas = F.coalesce("floor_areas", F.array().cast("array<double>"))
    if fallback:
        areas = F.when(F.size(areas) > 0, areas).otherwise(F.array("total_floor_area"))
    return buildings.select("*", F.posexplode(areas).alias("floor_idx", "area"))


def load_factor(keyed: DataFrame, rules: DataFrame, group: str = "grp", sub: str | None = None) -> DataFrame:
    """Adds load_factor: of the sub-type, else the group's default, else its first number."""
    first = rules.groupBy("grp").agg(F.min_by("factor", "ordinal").alias("_first"), F.max(F.when(F.col("sub_type") == "default", F.col("factor"))).alias("_default"))
    out = keyed.join(first.withColumnRenamed("grp", "_grp"), F.col(group) == F.col("_grp"), "left")
    choices = [F.col("_default"), F.col("_first")]
    if sub:
        exact = rules.select(F.col("grp").alias("_g"), F.col("sub_type").alias("_s"), F.col("factor").alias("_exact"))
        out = out.join(exact, (F.col(group) == F.col("_g")) & (F.col(sub) == F.col("_s")), "left")
        choices.insert(0, F.col("_exact"))
    return out.withColumn("load_factor", F.coalesce(*choices)).drop("_grp", "_first", "_default", "_g", "_s", "_exact")


def occupant_load(floors: DataFrame) -> DataFrame:
    """floors with load_factor: sum and greatest of whole persons by floor; none without a factor."""
    persons = F.floor(F.col("area") / F.col("load_factor"))
    return (
        floors.where("load_factor is not null")
        .groupBy("building_id")
        .agg(F.max("load_factor").alias("load_factor"), F.sum(persons).alias("total_occupants"), F.max(persons).alias("max_occupants"), F.sum("area").alias("total_area"))
    )


def exit_capacity(floors: DataFrame, min_mm: float = 1000.0) -> DataFrame:
    """floors with load_factor, stairway_mm, level_mm: widest need, rounded after the maximum."""
    persons = F.floor(F.col("area") / F.col("load_factor"))
    width = lambda mm: F.bround(F.max(F.greatest(persons * F.col(mm), F.lit(min_mm))), 1)
    return (
        floors.where("load_factor is not null and stairway_mm is not null")
        .groupBy("building_id")
        .agg(F.sum(persons).alias("total_occupants"), width("stairway_mm").alias("max_stairway_width_mm"), width("level_mm").alias("max_level_width_mm"))
    )


def detector_counts(floors: DataFrame, sprinkler_m: float = 2.8, smoke_m: float = 5.0) -> DataFrame:
    count = lambda m: F.sum(F.ceil(F.col("area") / F.lit(m * m)))
    return floors.groupBy("building_id").agg(
        count(sprinkler_m).alias("total_sprinklers"),
        count(smoke_m).alias("total_smoke_detectors"),
        F.lit(round(sprinkler_m * sprinkler_m, 2)).alias("sprinkler_coverage_m2"),
        F.lit(round(smoke_m * smoke_m, 2)).alias("smoke_detector_coverage_m2"),
    )


def extinguishers(floors: DataFrame, rules: DataFrame) -> DataFrame:
    """floors with hazard: a rating and at least 1 (below 100 m2) or 2 a floor."""
    rules = rules.select(F.col("hazard").alias("_h"), "rating", "max_area")
    out = floors.join(F.broadcast(rules), F.col("hazard") == F.col("_h")).drop("_h")  # a row for each hazard
    count = F.greatest(F.ceil(F.col("area") / F.col("max_area")), F.when(F.col("area") < 100, 1).otherwise(2))
    return out.withColumn("count", count.cast("long")).withColumn("floor_label", floor_label("floor_idx"))


def class_f(area: str, bands: DataFrame, rows: DataFrame) -> DataFrame:
    """Rating and count for a cooking area: its band, above all bands one 75F for each 0.25 m2."""
    b = bands.select("above", "upto", F.col("rating").alias("_rating"))
    out = rows.join(F.broadcast(b), (F.col(area) > F.col("above")) & (F.col(area) <= F.col("upto")), "left")  # 4 rows
    return out.withColumn("rating", F.coalesce("_rating", F.lit("75F"))).withColumn(
        "count", F.when(F.col("_rating").isNotNull(), F.lit(1)).otherwise(F.ceil(F.col(area) / 0.25)).cast("long")
    ).drop("above", "upto", "_rating")


def max_area() -> Column:
    """The largest floor, or the total where no floor is known."""
    return F.coalesce(F.array_max("floor_areas"), F.col("total_floor_area"))
