"""Wordings of findings, passed checks and reports, used by the engine and by its SQL."""

from __future__ import annotations

# --- Fixed values: formats whose %s are filled in, in this order -----------------------------

CLASS_A = "Class A extinguishers required: %s floor(s) assessed"
CLASS_B = "Class B/C extinguishers: flammable liquid hazard detected and addressed"
CLASS_F = "Class F extinguisher: kitchen cooking area assessed"
ELECTRICAL = "Electrical hazard: CO2/clean agent requirement identified"
LOAD = "Occupant load: %s total persons across %s floor(s) (Group %s, %s m²/person, max single-floor = %s)"
EXITS = "Exit capacity (Table 4): stairway factor %s mm/person, level factor %s mm/person — max stairway width %smm, max level width %smm"
TRAVEL = "Travel distance OK: %s (Group %s, %s%s)"
TRAVEL_WITHIN = "%sm ≤ %sm max"
TRAVEL_ALLOWED = "max %sm allowed"
SPRINKLERED = ", sprinklered"
INSTALLED = "Firefighting installations identified (Table 7, %s): %s"
DETECTORS = "Detection devices: %s sprinklers (spacing 2.8m, coverage 7.84m²/unit), %s smoke detectors (spacing 5.0m, coverage 25.0m²/unit)"
APPLIES = "NBCS 2026 Part F: Provisions ARE applicable (%s). Ref: NBCS 2026 Part F, Section 1.2"
APPLIES_NOT = "NBCS 2026 Part F: Provisions are NOT applicable (%s). Ref: NBCS 2026 Part F, Section 1.2"
ABOVE_HEIGHT = "Building height (%sm) exceeds %sm threshold for %s"
ANY_HEIGHT = "Any height — applicability is based on total building area"
ABOVE_AREA = "Floor area (%sm²) exceeds %sm² threshold for %s"
BELOW_BOTH = "Building height (%sm) does not exceed %sm and floor area (%sm²) does not exceed %sm² for %s occupancy"
NO_THRESHOLD = "Occupancy group '%s' not found in NBCS 2026 applicability table"
DEVICES = {
    "fire_extinguisher": "Fire Extinguisher",
    "first_aid_hose_reel": "Hose Reel",
    "wet_riser": "Wet Riser",
    "down_comer": "Down Comer",
    "yard_hydrant": "Yard Hydrant",
    "automatic_sprinkler": "Sprinkler System",
    "manual_fire_alarm": "Manual Fire Alarm",
    "auto_detection_alarm": "Auto Detection & Alarm",
}
CLAUSES = {
    "F-MISSING-AREA": "IS 2190:2024, Table 3, cl 7.7",
    "D-PROFESSIONAL": "IS 2190:2024, cl 7.6",
    "NBC-TD-NOT-PERMITTED": "NBC 2016 Part IV, Table 5",
    "NBC-TD-EXCEED": "NBC 2016 Part IV, Table 5",
    "NBC-FI-HEIGHT-NOT-PERMITTED": "NBC 2016 Part IV, Table 7",
}
BASEMENT_MISSING = "Basement count is set but basement area is 0 m² — enter basement area to evaluate Note 4 (sprinkler in basement)."
CONSTRUCTION_MISSING = "Construction type not selected — travel-distance check will be skipped."
AMOUNTS = {
    "underground_tank_litres": ("Underground Static Tank", "litres"),
    "terrace_tank_litres": ("Terrace Tank", "litres"),
    "underground_pump_lpm": ("Underground Fire Pump", "L/min"),
    "terrace_pump_lpm": ("Terrace Fire Pump", "L/min"),
}
NOT_REQUIRED = "Not required by NBC Part 4 Table 7 for the selected occupancy and building parameters."
REQUIRED = "Required by NBC Part 4 Table 7 for the applicable tier of: %s."
REQUIRED_OF = {
    "wet_riser": "Wet riser required because occupancy/height/area tier for %s triggers Table 7 wet-riser column (Cols. wet riser + associated notes).",
    "down_comer": "Down comer required because occupancy/height/area tier for %s triggers Table 7 down-comer column (Cols. down comer + associated notes).",
}
DASH, NONE = "—", "— None —"
