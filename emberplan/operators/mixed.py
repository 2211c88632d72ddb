"""Mixed occupancies: codes in order, per-occupancy tiers, strictest of many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.rules import AMOUNTS
from .installs import installations


def occupancy_codes(buildings: DataFrame, zones: DataFrame, primary) -> DataFrame:
    """(building_id, ordinal, code, zone_area): the primary code, then zones' in floor order, each
    once. zone_area is a zone's largest.

    Zones are reduced to one row for each building and code before anything is collected, so
    that a building's list is as long as its distinct codes.
    """
    z = zones.groupBy("building_id", "occupancy_code").agg(F.min("floor_idx").alias("first"), F.max("area_m2").alias("zone_area"))
    one = z.select("building_id", F.col("first").alias("ordinal"), F.col("occupancy_code").alias("code"), "zone_area")
    p = buildings.select("building_id", F.lit(-1).alias("ordinal"), primary.alias("code"), F.lit(None).cast("double").alias("zone_area")).where("code is not null")
    return p.unionByName(one).groupBy("building_id", "code").agg(F.min("ordinal").alias("ordinal"), F.max("zone_area").alias("zone_area"))


def evaluate(codes: DataFrame, buildings: DataFrame, limits, tiers, notes, keep: bool = False) -> DataFrame:
    """Each code's installations; codes above their height limit or without a tier fall away, or
    stay with nulls if keep is set."""
    b = buildings.select("building_id", "building_height", "number_of_floors", "basement_area", F.coalesce(F.array_max("floor_areas"), F.col("total_floor_area")).alias("_max"))
    rows = codes.join(b, "building_id").withColumn("subdivision", F.col("code")).withColumn("grp", F.substring_index("code", "-", 1)).withColumn("tier_area", F.coalesce("zone_area", "_max"))
    out = installations(rows, limits, tiers, notes)
    return out if keep else out.where("tier_label is not null")


def dropped(evaluated: DataFrame) -> DataFrame:
    """(building_id, ordinal, code, reason): codes that fell away, of rows that evaluate() kept."""
    reason = F.when(F.col("over_height"), "above_height_limit").otherwise("no_tier")
    return evaluated.where("tier_label is null").select("building_id", "ordinal", "code", reason.alias("reason"))


def _by_building(evaluated: DataFrame, columns: list[str]) -> DataFrame:
    """(building_id, occ): a building's occupancies in order, as structs; the one shuffle."""
    return evaluated.groupBy("building_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "code", *columns))).alias("occ"))


def system_items(evaluated: DataFrame, systems: list[dict]) -> DataFrame:
    """(building_id, id, status, triggered_by, clauses, standards) for every system of every building.

    A building's occupancies, some codes at most, meet in one row; the systems, which are rules,
    are expressions over that row.
    """
    rows = _by_building(evaluated, [*[r["field"] for r in systems], "met"])

    def item(r: dict):
        by = F.filter("occ", lambda x: x[r["field"]])
        notes = F.flatten(F.transform(by, lambda x: F.transform(F.filter(x["met"], lambda n: n["field"] == F.lit(r["field"])), lambda n: F.concat(F.lit("Table 7 Note "), n["note_id"]))))
        required, standards = F.size(by) > 0, F.array(*[F.lit(x) for x in r["standards"]]).cast("array<string>")
        return F.struct(
            F.lit(r["id"]).alias("id"),
            F.when(required, "required").otherwise("not_required").alias("status"),
            F.transform(by, lambda x: x["code"]).alias("triggered_by"),
            F.array_sort(F.array_distinct(F.concat(F.array(F.lit(r["clause"])), notes))).alias("clauses"),
            F.when(required, standards).otherwise(F.array().cast("array<string>")).alias("standards"),
        )

    return rows.select("building_id", F.inline(F.array(*[item(r) for r in systems])))


def strictest_amounts(evaluated: DataFrame) -> DataFrame:
    """(building_id, field, value, triggered_by): the greatest of each amount, with all ties in order."""
    rows = _by_building(evaluated, list(AMOUNTS))

    def amount(a: str):
        most = F.array_max(F.transform("occ", lambda x: x[a]))
        who = F.transform(F.filter("occ", lambda x: x[a] == most), lambda x: x["code"])
        return F.struct(F.lit(a).alias("field"), most.cast("long").alias("value"), who.alias("triggered_by"))

    return rows.select("building_id", F.inline(F.array(*[amount(a) for a in AMOUNTS]))).where("value is not null")


def standards_grid(evaluated: DataFrame, systems: list[dict]) -> DataFrame:
    """(building_id, standard, titles): titles of the required systems under each standard, sorted."""
    rows = _by_building(evaluated, [r["field"] for r in systems])

    def required(field: str):
        return F.exists("occ", lambda x: x[field])

    def titles(standard: str):
        under = [F.when(required(r["field"]), F.lit(r["title"])) for r in systems if standard in r["standards"]]
        return F.struct(F.lit(standard).alias("standard"), F.array_sort(F.array_distinct(F.array_compact(F.array(*under)))).alias("titles"))

    names = sorted({x for r in systems for x in r["standards"]})
    return rows.select("building_id", F.inline(F.array(*[titles(x) for x in names]))).where("size(titles) > 0")
