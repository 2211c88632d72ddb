"""Installation tiers with ordered notes, height limits, travel distances, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rules import AMOUNTS, FLAGS, NBCS_FLAGS


def condition(cond, height, floors, basement) -> Column:
    """Whether a note's condition holds; an unknown one does not."""
    return (
        F.when(cond == "always", True)
        .when(cond == "basement_area_gt_200", basement > 200)
        .when(cond == "floors_gt_2", floors > 2)
        .when(cond == "floors_gt_1", floors > 1)
        .when(cond == "height_gte_15", height >= 15)
        .when(cond == "height_gte_60", height >= 60)
        .otherwise(False)
    )


def keyed(rows: DataFrame, keys: DataFrame, name: str = "rule_key", sub: str = "subdivision", group: str = "grp") -> DataFrame:
    """Adds the subdivision if it is among keys.key, else the group if it is, else null."""
    k = keys.select("key").distinct()
    out = rows.join(F.broadcast(k.select(F.col("key").alias("_s"))), F.col(sub) == F.col("_s"), "left")  # rule keys: a few dozen
    out = out.join(F.broadcast(k.select(F.col("key").alias("_g"))), F.col(group) == F.col("_g"), "left")
    return out.withColumn(name, F.coalesce("_s", "_g")).drop("_s", "_g")


def over_height(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds max_height (null: none) and over_height."""
    out = keyed(rows, limits, "_limit_key")
    lim = limits.select(F.col("key").alias("_k"), "max_height")
    out = out.join(F.broadcast(lim), F.col("_limit_key") == F.col("_k"), "left").drop("_k", "_limit_key")
    return out.withColumn("over_height", F.coalesce(F.col("building_height") > F.col("max_height"), F.lit(False)))


def packed_tiers(tiers: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """A row for each key with its tiers in order; the tables are rules, a few rows a key."""
    if notes is not None:
        n = notes.groupBy("key", "tier_idx").agg(F.array_sort(F.collect_list(F.struct("note_idx", "note_id", "cond", "field", "additional", "set_value"))).alias("notes"))
        tiers = tiers.join(n, ["key", "tier_idx"], "left")
    cols = [c for c in tiers.columns if c != "key"]
    return tiers.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("tier_idx", *[c for c in cols if c not in ("tier_idx", "notes")]))).alias("tiers"), *([F.collect_list(F.struct("tier_idx", "notes")).alias("tier_notes")] if notes is not None else []))


def first_tier(rows: DataFrame, tiers: DataFrame, notes: DataFrame | None = None, fallback: bool = True, area: str = "tier_area", floors: str = "number_of_floors", key: str = "rule_key") -> DataFrame:
    """Adds tier: the first whose criteria all hold, else the last (fallback) or null; and its notes.

    The tiers of a key travel as one array, so the first match is a projection behind a small
    hash join, without a sort or a shuffle of the buildings.
    """
    packed = packed_tiers(tiers, notes).withColumnRenamed("key", "_key")
    out = rows.join(F.broadcast(packed), F.col(key) == F.col("_key"), "left")  # rule keys: a few dozen
    h, a, n = F.col("building_height"), F.coalesce(F.col(area), F.lit(0.0)), F.coalesce(F.col(floors), F.lit(0))

    def holds(t):
        return (
            (h <= t["max_height"])
            & (t["min_height"].isNull() | (h >= t["min_height"]))
            & (t["max_area"].isNull() | (a <= 0) | (a <= t["max_area"]))
            & (t["min_area"].isNull() | (a <= 0) | (a >= t["min_area"]))
            & (t["max_floors"].isNull() | (n <= 0) | (n <= t["max_floors"]))
            & (t["min_floors"].isNull() | (n <= 0) | (n >= t["min_floors"]))
        )

    first = F.get(F.filter("tiers", holds), F.lit(0))
    out = out.withColumn("tier", F.coalesce(first, F.try_element_at("tiers", F.lit(-1))) if fallback else first)
    if notes is not None:
        own = F.get(F.filter("tier_notes", lambda x: x["tier_idx"] == F.col("tier.tier_idx")), F.lit(0))
        out = out.withColumn("notes", own["notes"]).drop("tier_notes")
    return out.drop("tiers", "_key")


def with_values(rows: DataFrame) -> DataFrame:
    """Unpacks tier and applies the notes whose condition holds, in order.

    A set value replaces, an additional one adds (to 0 where there is none), a flag becomes true.
    """
    met = F.filter(F.coalesce("notes", F.array().cast(rows.schema["notes"].dataType)), lambda n: condition(n["cond"], F.col("building_height"), F.coalesce("number_of_floors", F.lit(0)), F.coalesce("basement_area", F.lit(0.0))))
    out = rows.withColumn("met", met)

    def amount(field):
        def step(acc, n):
            return F.when(n["field"] != field, acc).when(n["set_value"].isNotNull(), n["set_value"]).when(n["additional"].isNotNull(), F.coalesce(acc, F.lit(0)) + n["additional"]).otherwise(acc)

        return F.aggregate("met", F.col(f"tier.{field}"), step)

    def flag(field):
        return F.col(f"tier.{field}") | F.exists("met", lambda n: (n["field"] == field) & n["set_value"].isNull() & n["additional"].isNull())

    return out.select("*", F.col("tier.label").alias("tier_label"), *[flag(f).alias(f) for f in FLAGS], *[amount(a).alias(a) for a in AMOUNTS])


def installations(rows: DataFrame, limits: DataFrame, tiers: DataFrame, notes: DataFrame) -> DataFrame:
    """rows (grp, subdivision, building_height, tier_area, number_of_floors, basement_area) with
    over_height, tier_label, FLAGS and AMOUNTS; these are null above the height limit or without a tier."""
    out = over_height(rows, limits)
    out = keyed(out, tiers).withColumn("rule_key", F.when(~F.col("over_height"), F.col("rule_key")))
    return with_values(first_tier(out, tiers, notes))


def travel(rows: DataFrame, distances: DataFrame, bonus: float) -> DataFrame:
    """Adds base_m, max_m (-1: not permitted; null: no rule) and td_rule (a violation's id or null)."""
    key = F.when((F.col("grp") == "G") & F.col("subdivision").isin("G-1", "G-2", "G-3"), F.col("subdivision")).otherwise(F.col("grp"))
    d = distances.select(F.col("key").alias("_k"), "type12", "type34")
    out = rows.withColumn("_key", key).join(F.broadcast(d), F.col("_key") == F.col("_k"), "left")  # rule keys
    base = F.when(F.col("_k").isNotNull() & F.col("construction_type").isNotNull(), F.coalesce(F.when(F.col("construction_type") == "type12", F.col("type12")).otherwise(F.col("type34")), F.lit(-1.0)))
    out = out.withColumn("base_m", base)
    out = out.withColumn("max_m", F.when((F.col("base_m") > 0) & F.coalesce("has_sprinklers", F.lit(False)), F.col("base_m") * bonus).otherwise(F.col("base_m")))
    rule = F.when(F.col("max_m") == -1, "NBC-TD-NOT-PERMITTED").when(F.coalesce("travel_distance_m", F.lit(0.0)) > F.col("max_m"), "NBC-TD-EXCEED")
    return out.withColumn("td_rule", rule).drop("_key", "_k", "type12", "type34")


def system_cards(rows: DataFrame) -> DataFrame:
    """(building_id, ordinal, system, triggers): up to six cards for a building with a tier."""
    c = F.col
    triggers = lambda *p: F.filter(F.array(*[F.when(c(f), F.lit(t)) for f, t in p]), lambda x: x.isNotNull())
    water = F.lit(False)
    for a in AMOUNTS:
        water = water | (F.coalesce(c(a), F.lit(0)) > 0)
    cards = [
        (c("fire_extinguisher"), "Fire Extinguishers", triggers()),
        (c("first_aid_hose_reel") | c("wet_riser") | c("down_comer"), "Internal Hydrants & Hose Reels", triggers(("first_aid_hose_reel", "Hose Reel"), ("wet_riser", "Wet Riser"), ("down_comer", "Down Comer"))),
        (c("yard_hydrant"), "External (Yard) Hydrants", triggers()),
        (water, "Water Supply & Fire Pumps", triggers()),
        (c("automatic_sprinkler"), "Automatic Sprinkler System", triggers()),
        (c("auto_detection_alarm") | c("manual_fire_alarm"), "Fire Detection & Alarm", triggers(("auto_detection_alarm", "Auto Detection"), ("manual_fire_alarm", "Manual Alarm"))),
    ]
    rows = rows.where("tier_label is not null")
    made = F.array(*[F.when(t, F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("system"), x.cast("array<string>").alias("triggers"))) for i, (t, s, x) in enumerate(cards)])
    return rows.select("building_id", F.inline(F.filter(made, lambda x: x.isNotNull())))


def applicability(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds label, height_applies, area_applies, applicable (false without a rule): strictly above."""
    out = keyed(rows, thresholds, "_key")
    t = thresholds.select(F.col("key").alias("_k"), "label", "height_m", "area_m2")
    out = out.join(F.broadcast(t), F.col("_key") == F.col("_k"), "left")  # rule keys
    found = F.col("_k").isNotNull()
    out = out.withColumn("height_applies", found & F.coalesce(F.col("building_height") > F.col("height_m"), F.lit(True)))
    out = out.withColumn("area_applies", found & F.coalesce(F.col("max_area") > F.col("area_m2"), F.lit(False)))
    return out.withColumn("applicable", F.col("height_applies") | F.col("area_applies")).drop("_key", "_k")


def nbcs_installations(rows: DataFrame, tiers: DataFrame, keep: bool = False) -> DataFrame:
    """rows (grp, nbcs_subdivision, building_height, nbcs_area, has_kitchen, has_ev_parking) whose
    first tier holds (there is no fallback): level, self_cert and the flags (null: not named).
    Rows without a tier go, or stay with nulls if keep is set."""
    t = tiers.groupBy(F.col("grp").alias("_g"), F.col("sub").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("tier_idx", *[c for c in tiers.columns if c not in ("tier_idx", "grp", "sub")]))).alias("tiers"))
    out = rows.join(F.broadcast(t), (F.col("grp") == F.col("_g")) & (F.col("nbcs_subdivision") == F.col("_s")), "left")  # rule keys
    h, a = F.col("building_height"), F.col("nbcs_area")
    holds = lambda t: (t["min_height"].isNull() | (h >= t["min_height"])) & (t["max_height"].isNull() | (h <= t["max_height"])) & (t["min_area"].isNull() | (a >= t["min_area"])) & (t["max_area"].isNull() | (a <= t["max_area"]))
    out = out.withColumn("t", F.get(F.filter("tiers", holds), F.lit(0)))
    out = out if keep else out.where("t is not null")
    kitchen = F.col("has_kitchen") & (F.col("grp") == "A") & (F.col("t.level") == "HL-1")
    out = out.withColumn("_level", F.when(kitchen, "HL-2").otherwise(F.col("t.level")))
    ev = F.col("has_ev_parking") & (F.col("_level").startswith("HL") | F.col("_level").isin("CL-2", "CL-3", "CL-4"))
    out = out.withColumn("ev", F.coalesce(ev, F.lit(False)))
    cert = F.coalesce((a <= F.col("t.self_area")) & (h <= F.col("t.self_height")), F.lit(False))
    out = out.withColumn("self_cert", cert).withColumn("level", F.when(cert, "SELF-CERT").when(F.col("ev"), "CL-5").otherwise(F.col("_level")))
    flags = [(F.when(F.col("ev"), True).otherwise(F.col(f"t.{f}")) if f == "automatic_sprinkler" else F.col(f"t.{f}")).alias(f"nbcs_{f}") for f in NBCS_FLAGS]
    return out.select(*rows.columns, "level", "self_cert", F.col("t.tier_idx").alias("nbcs_tier"), *flags)


def differs() -> Column:
    """Whether the two layers disagree on a system; a flag that is not named differs from both."""
    out = F.lit(False)
    for f in ("automatic_sprinkler", "yard_hydrant", "wet_riser"):
        out = out | ~F.col(f"nbcs_{f}").eqNullSafe(F.col(f))
    return out


def nbcs_metrics(rows: DataFrame, load: DataFrame, exits: DataFrame, travel: DataFrame, keep: bool = False) -> DataFrame:
    """rows (grp, nbcs_subdivision, total_floor_area, max_area): whole persons, widths, distance.
    Rows of groups without exit widths go, or stay with nulls if keep is set."""
    exact = load.select(F.col("grp").alias("_g1"), F.col("sub").alias("_s1"), F.coalesce("gross", "net").alias("_f1"))
    default = load.where("sub = 'default'").select(F.col("grp").alias("_g2"), F.coalesce("gross", "net").alias("_f2"))
    out = rows.join(F.broadcast(exact), (F.col("grp") == F.col("_g1")) & (F.col("nbcs_subdivision") == F.col("_s1")), "left")  # rule keys, as all below
    out = out.join(F.broadcast(default), F.col("grp") == F.col("_g2"), "left").withColumn("factor", F.coalesce("_f1", "_f2"))
    out = out.join(F.broadcast(exits.withColumnRenamed("grp", "_g3")), F.col("grp") == F.col("_g3"), "left" if keep else "inner").drop("_g3")
    t1 = travel.select(F.col("key").alias("_k1"), F.col("metres").alias("_m1"))
    t2 = travel.select(F.col("key").alias("_k2"), F.col("metres").alias("_m2"))
    out = out.join(F.broadcast(t1), F.col("grp") == F.col("_k1"), "left").join(F.broadcast(t2), F.col("nbcs_subdivision") == F.col("_k2"), "left")
    persons = (F.col("max_area") / F.coalesce("factor", F.lit(12.5))).cast("long")
    return out.select(
        *rows.columns,
        (F.col("total_floor_area") / F.col("factor")).cast("long").alias("nbcs_occupants"),
        (persons * F.col("stairway_mm")).alias("nbcs_stairway_mm"),
        (persons * F.col("level_mm")).alias("nbcs_level_mm"),
        "dead_end_m",
        F.when(F.col("_k1").isNotNull(), F.coalesce("_m2", "_m1")).alias("nbcs_travel_m"),
    )
