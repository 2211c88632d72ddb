"""Hazard classes, violations, scores and extraction confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _reasons(tests: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(t, F.lit(r)) for t, r in tests]), lambda x: x.isNotNull())


def with_hazard(b: DataFrame) -> DataFrame:
    """Adds hazard and hazard_reasons: any high criterion, else any moderate one, else low."""
    liquid, gas = _known("flammable_liquids_litres"), _known("flammable_gases_litres")
    occ, area = _known("occupant_count"), _known("total_floor_area")
    high = _reasons([(_known("building_height") > 15, "height"), (occ > 250, "occupants"), (area > 3000, "area"), (gas > 3000, "gas"), (liquid > 1000, "liquid")])
    moderate = _reasons([(occ.between(15, 250), "occupants"), (area.between(300, 3000), "area"), (gas.between(500, 3000), "gas"), (liquid.between(250, 1000), "liquid")])
    b = b.withColumn("_high", high).withColumn("_moderate", moderate)
    hazard = F.when(F.size("_high") > 0, "high").when(F.size("_moderate") > 0, "moderate").otherwise("low")
    return b.withColumn("hazard", hazard).withColumn("hazard_reasons", F.when(F.size("_high") > 0, F.col("_high")).otherwise(F.col("_moderate"))).drop("_high", "_moderate")


def electrical(b: DataFrame) -> DataFrame:
    """The fixed requirement of buildings with electrical hazards."""
    return b.where("has_electrical_hazards").select("building_id", F.lit("C").alias("fire_class"), F.lit("CO2-2kg").alias("rating"), F.lit(1).cast("long").alias("count"))


def bands(score: Column) -> tuple[Column, Column]:
    grade = F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("D")
    noc = F.when(score >= 90, "READY").when(score >= 60, "CONDITIONAL").otherwise("NOT_READY")
    return grade, noc


def confidence(b: DataFrame) -> DataFrame:
    """(building_id, score, overall, flags): penalties of missing and implausible inputs."""
    total, n, occ, height = _known("total_floor_area"), _known("number_of_floors"), _known("occupant_count"), _known("building_height")
    k = F.size(F.coalesce("floor_areas", F.array().cast("array<double>")))
    floors = F.aggregate("floor_areas", F.lit(0.0), lambda a, x: a + x)
    density = F.try_divide(total, occ)
    per_floor = F.try_divide(height, n)
    tests = [
        (total <= 0, "area", 30),
        (n <= 0, "floors", 20),
        (k == 0, "floor_areas", 25),
        ((k > 0) & (n != 0) & (k != n), "floor_count", 15),
        (occ <= 0, "occupants", 10),
        (height <= 0, "height", 10),
        (total > 50000, "large", 10),
        (n > 20, "tall", 5),
        (occ > 5000, "crowded", 5),
        ((k > 0) & (total > 0) & (F.try_divide(F.abs(total - floors), total) > 0.10), "sum", 10),
        ((occ > 0) & (total > 0) & (density < 2), "dense", 10),
        ((occ > 0) & (total > 0) & (density > 50), "sparse", 5),
        ((height > 0) & (n > 0) & ((per_floor < 2.5) | (per_floor > 6)), "storey", 5),
    ]
    lost = sum((F.when(t, F.lit(p)).otherwise(0) for t, _, p in tests), F.lit(0))
    b = b.withColumn("_score", F.greatest(F.lit(0), 100 - lost))
    overall = F.when(F.col("_score") >= 70, "high").when(F.col("_score") >= 40, "medium").otherwise("low")
    return b.select("building_id", F.col("_score").alias("score"), overall.alias("overall"), _reasons([(t, r) for t, r, _ in tests]).alias("flags"))


def missing_inputs() -> Column:
    """Hints, in order: a basement count without its area, no construction type."""
    return _reasons([((_known("basement_area") == 0) & (_known("basement_count") > 0), "basement_area"), (F.coalesce("construction_type", F.lit("")) == "", "construction_type")])
