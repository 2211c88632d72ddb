"""Column functions that read fields from drawing text. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: patterns, in the order in which they are tried, and word lists -----------

HEIGHT = [r"(?:building\s+)?height\s*[=:]\s*(\d+\.?\d*)\s*(?:m|mtr|meter)?", r"(?:total\s+)?ht\.?\s*[=:]\s*(\d+\.?\d*)\s*(?:m|mtr)?", r"(\d+\.?\d*)\s*m\s*(?:height|ht)"]
STOREYS = [r"(\d+)\s*(?:floors?|storeys?|stories?)", r"(?:floors?|storeys?|stories?)\s*[=:]\s*(\d+)", r"(?:G\s*\+\s*)(\d+)", r"(?:no\.?\s*of\s+floors?)\s*[=:]\s*(\d+)"]
AREAS = [
    ("basement_area", r"(?:basement\s+area)\s*[=:]\s*(\d+\.?\d*)\s*(?:sq\.?\s*m|m²|sqm)?"),
    ("floor_area", r"(?:floor\s+area|carpet\s+area|built.?up\s+area|area)\s*[=:]\s*(\d+\.?\d*)\s*(?:sq\.?\s*m|m²|sqm)?"),
    ("generic_area", r"(\d+\.?\d*)\s*(?:sq\.?\s*m|m²|sqm)"),
]
BASEMENT_LEVELS = [r"(\d+)\s*(?:basement|bsmt)\s*(?:level|floor)?s?", r"(?:basement|bsmt)\s*(?:level|floor)?s?\s*[=:]\s*(\d+)", r"B\s*(\d+)\s*(?:floor|level)"]
DIMENSIONS = [("m", r"(\d+\.?\d*)\s*(?:m(?:eter|etre)?s?)\b", 1.0), ("mm", r"(\d+\.?\d*)\s*(?:mm)\b", 0.001), ("height", r"(?:height|ht|h)\s*[=:]\s*(\d+\.?\d*)\s*(?:m|mtr)?\b", 1.0), ("sqm", r"(\d+\.?\d*)\s*(?:sq\.?\s*m|m²|sqm)\b", 1.0), ("bare_number", r"\b(\d{4,6})\b", 1.0)]
PROJECT = [r"(?:project|building|tower|complex|residence|apartment)\s*[:\-]?\s*(.+?)(?:\n|$)", r"(?:name)\s*[:\-]\s*(.+?)(?:\n|$)"]
OCR_PROJECT = r"\b(?:CLIENT|PROJECT\s*NAME|BUILDING\s*NAME)\b\s*[:\-]?\s*(.+)"
OCR_STOP = ["project", "name", "dwg", "date", "drawing", "scale", "checked", "client", "architect", "consultant", "sheet", "no", "rev", "revision", "by", "from", "the", "their", "under", "for", "and", "is", "was", "of", "to"]
SCALES = [r"(?:scale|sc)\s*[=:]\s*(1\s*:\s*\d+)", r"(1\s*:\s*\d{2,4})\b", r"(?:scale|sc)\s*[=:]\s*(\d+\s*:\s*\d+)"]
SCALE_CM = r"1\s*cm\.?\s*=\s*(\d+\.?\d*)\s*m(?:t|tr|eters?)?\b"
UNITS = r"\b(?:all\s+dimensions?\s+(?:are\s+)?in\s+)(mm|meters?|m)\b"
PAIR = r"\b(\d{3,6})\s*[xX×]\s*(\d{3,6})\b"
FLOOR_LABELS = [r"\bGROUND\s+FLOOR\b", r"\bFIRST\s+FLOOR\b", r"\bSECOND\s+FLOOR\b", r"\bTHIRD\s+FLOOR\b", r"\bFOURTH\s+FLOOR\b", r"\bFIFTH\s+FLOOR\b", r"\bTOP\s+FLOOR\b", r"\bBASEMENT\b", r"\bMEZZANINE\b", r"\bTERRACE\b", r"\bROOF\s*(?:FLOOR|LEVEL)?\b", r"\bSTILT\s*(?:FLOOR|PARKING)?\b", r"\bTYPICAL\s+FLOOR\b", r"\bGF\b", r"\bB\s*\d\b", r"\bF\s*\d{1,2}\b"]
ROOM_LABELS = [r"\bKITCHEN\b", r"\bBEDROOM\b", r"\bBED\s*ROOM\b", r"\bTOILET\b", r"\bBATHROOM\b", r"\bBATH\s*ROOM\b", r"\bLIVING\s+ROOM\b", r"\bDINING\b", r"\bPARKING\b", r"\bLOBBY\b", r"\bSTORE\s*(?:ROOM)?\b", r"\bOFFICE\b", r"\bSTAIRCASE\b", r"\bSTAIR\s*(?:CASE|WELL)?\b", r"\bLIFT\b", r"\bBALCONY\b", r"\bCORRIDOR\b", r"\bHALL\b", r"\bPANTRY\b", r"\bWASHROOM\b", r"\bLOUNGE\b"]
NOTES_LINE, KEY_PLAN, DIMENSION_LINE = r"^\s*NOTES?\s*[:\-]", r"\b(?:KEY\s+PLAN|LOCATION\s+PLAN)\b", r"^\s*\d+\.?\d*\s*(?:mm|m|sq\.?\s*m|m²|sqm)?\s*$"
CITIES = ["Mumbai", "Delhi", "Bangalore", "Bengaluru", "Hyderabad", "Ahmedabad", "Chennai", "Kolkata", "Pune", "Jaipur", "Surat", "Lucknow", "Kanpur", "Nagpur", "Indore", "Thane", "Bhopal", "Vadodara", "Visakhapatnam", "Patna", "Ghaziabad", "Ludhiana", "Agra", "Nashik", "Faridabad", "Meerut", "Rajkot", "Varanasi", "Coimbatore", "Noida", "Gurugram", "Chandigarh"]
STATES = ["Maharashtra", "Gujarat", "Karnataka", "Tamil Nadu", "Telangana", "Rajasthan", "Uttar Pradesh", "Madhya Pradesh", "Kerala", "West Bengal", "Delhi", "Haryana", "Punjab", "Andhra Pradesh", "Bihar", "Odisha", "Jharkhand", "Chhattisgarh", "Assam", "Goa", "Uttarakhand"]
OCCUPANCY = [("hotel", "A-5"), ("hospital", "C-1"), ("school", "D-1"), ("college", "D-2"), ("office", "E-1"), ("mall", "F-2"), ("shop", "F-2"), ("apartment", "A-4"), ("residential", "A-4"), ("warehouse", "G-1"), ("factory", "G-2"), ("cinema", "D-3"), ("banquet", "D-3"), ("restaurant", "D-4"), ("hostel", "A-3"), ("dormitory", "A-3"), ("assembly", "D-5"), ("theater", "D-5"), ("theatre", "D-5")]
DXF_OCCUPANCY = [("hotel", "A-5"), ("hospital", "C-1"), ("school", "D-1"), ("office", "E-1"), ("apartment", "A-4"), ("residential", "A-4"), ("mall", "F-2"), ("shop", "F-2"), ("restaurant", "D-4"), ("warehouse", "G-1")]
FORM_OCCUPANCY = [("hotel", "A-5"), ("motel", "A-1"), ("hostel", "A-3"), ("dormitory", "A-3"), ("apartment", "A-4"), ("residential", "A-4"), ("flat", "A-4"), ("hospital", "C-1"), ("clinic", "C-2"), ("school", "D-1"), ("college", "D-2"), ("cinema", "D-3"), ("banquet", "D-3"), ("exhibition", "D-3"), ("restaurant", "D-4"), ("assembly", "D-5"), ("theater", "D-5"), ("theatre", "D-5"), ("office", "E-1"), ("bank", "E-1"), ("lab", "E-2"), ("laboratory", "E-2"), ("data center", "E-3"), ("datacenter", "E-3"), ("mall", "F-2"), ("shop", "F-2"), ("retail", "F-2"), ("market", "F-2"), ("warehouse", "G-1"), ("storage", "G-1"), ("factory", "G-2"), ("industrial", "J")]
FIRE_RESISTIVE = ["rcc", "reinforced concrete", "fire-resistive", "fire resistive", "steel frame", "concrete encasement", "r.c.c"]
WOOD = ["wood frame", "timber", "ordinary construction", "wood-frame"]


def _ci(p: str) -> Column:
    return F.lit("(?i)" + p)


def found(text, pattern: str, group: int = 1) -> Column:
    """The group of the first match, ignoring case; null without one."""
    return F.nullif(F.regexp_extract(text, "(?i)" + pattern, group), F.lit(""))


def all_found(text, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, _ci(pattern), F.lit(group))


def first_in_range(text, patterns: list[str], low: float, high: float, kind: str = "double", plus_one: int | None = None) -> Column:
    """The first pattern's first match within the range; a value out of it lets the next try."""
    tried = []
    for i, p in enumerate(patterns):
        v = found(text, p).try_cast(kind)
        v = v + 1 if i == plus_one else v
        tried.append(F.when(v.between(low, high), v))
    return F.coalesce(*tried)


def height(text) -> Column:
    return first_in_range(text, HEIGHT, 2.0, 500.0)


def storeys(text) -> Column:
    """G+N counts the ground floor too."""
    return first_in_range(text, STOREYS, 1, 200, "int", plus_one=2)


def basement_levels(text) -> Column:
    return first_in_range(text, BASEMENT_LEVELS, 1, 10, "int")


def _valued(pattern: str):
    return lambda raw: F.struct(raw.alias("raw"), F.regexp_extract(raw, "(?i)" + pattern, 1).cast("double").alias("value"))


def _labelled(label: str):
    return lambda x: F.struct(F.lit(label).alias("label"), x["value"].alias("value"))


def _scaled(unit: str, factor: float):
    return lambda v: F.struct(F.lit(unit).alias("unit"), (v.cast("double") * factor).alias("value"))


def areas(text) -> Column:
    """ARRAY<STRUCT<label, value>>: what a more specific pattern has claimed is gone for the next."""
    text = F.col(text) if isinstance(text, str) else text
    out = []
    for label, p in AREAS:
        ok = F.filter(F.transform(all_found(text, p, 0), _valued(p)), lambda x: x["value"].between(5.0, 100000.0))
        out.append(F.transform(ok, _labelled(label)))
        # Longer raw texts first, so that none is cut by one that it contains.
        claimed = F.reverse(F.array_sort(F.transform(ok, lambda x: F.struct(F.length(x["raw"]).alias("n"), x["raw"].alias("raw")))))
        text = F.aggregate(claimed, text, lambda t, x: F.replace(t, x["raw"], F.lit(" # ")))
    return F.concat(*out)


def dimensions(text) -> Column:
    """ARRAY<STRUCT<unit, value>> of every dimension-like number, by pattern."""
    return F.concat(*[F.transform(all_found(text, p), _scaled(u, k)) for u, p, k in DIMENSIONS])


def project_name(text) -> Column:
    return F.substring(F.trim(F.coalesce(*[found(text, p) for p in PROJECT]), F.lit(" \t\n")), 1, 100)


def ocr_project_name(text) -> Column:
    """Words after the keyword up to a label word, at most 8; null below 3 characters."""
    words = F.slice(F.split(F.trim(found(text, OCR_PROJECT)), r"\s+"), 1, 8)
    stop = F.array(*[F.lit(w) for w in OCR_STOP])
    kept = F.aggregate(
        words,
        F.struct(F.lit(False).alias("ended"), F.array().cast("array<string>").alias("w")),
        lambda a, w: F.struct((a["ended"] | F.array_contains(stop, F.lower(F.trim(w, F.lit(".,:;-"))))).alias("ended"), F.when(a["ended"] | F.array_contains(stop, F.lower(F.trim(w, F.lit(".,:;-")))), a["w"]).otherwise(F.array_append(a["w"], w)).alias("w")),
    )["w"]
    name = F.trim(F.array_join(kept, " "), F.lit(" .,:-"))
    return F.when(F.length(name) >= 3, F.substring(name, 1, 100))


def first_listed(text, names: list[str]) -> Column:
    """The first name, in list order, that stands anywhere in the text, ignoring case."""
    up = F.upper(text)
    return F.get(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(up, F.upper(n))), F.lit(0))


def occupancy(text, keywords: list[tuple[str, str]] = OCCUPANCY) -> Column:
    """STRUCT<hint, code> of the first keyword found anywhere, also within a word."""
    low = F.lower(text)
    return F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("hint"), F.lit(c).alias("code")) for k, c in keywords]), lambda x: F.contains(low, x["hint"])), F.lit(0))


def construction(text) -> Column:
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return F.when(has(FIRE_RESISTIVE), "type12").when(has(WOOD), "type34")


def mentions(text, pattern: str) -> Column:
    """True or null, never false."""
    return F.when(F.regexp_like(text, _ci(pattern)), F.lit(True))


def labels(text, patterns: list[str]) -> Column:
    """Every label found, upper case, white space collapsed, each once, sorted."""
    raw = F.flatten(F.array(*[all_found(text, p, 0) for p in patterns]))
    return F.array_sort(F.array_distinct(F.transform(raw, lambda x: F.upper(F.regexp_replace(F.trim(x), r"\s+", " ")))))


def scale_ratios(text) -> Column:
    """Distinct ratios in the order of the patterns; 1 cm = N m is 1:100N."""
    plain = F.flatten(F.array(*[all_found(text, p) for p in SCALES]))
    plain = F.transform(plain, lambda x: F.replace(x, F.lit(" "), F.lit("")))
    cm = F.filter(F.transform(all_found(text, SCALE_CM), lambda x: x.cast("double")), lambda v: (v > 0) & (v < 1000))
    return F.array_distinct(F.concat(plain, F.transform(cm, lambda v: F.concat(F.lit("1:"), F.bround(v * 100).cast("long").cast("string")))))


def scale(text, header_units=None) -> Column:
    """STRUCT<value, unit, confidence, source, ambiguous>."""
    ratios = scale_ratios(text)
    value = F.get(ratios, F.lit(0))
    unit_text = F.lower(found(text, UNITS))
    said = F.when(unit_text == "mm", "mm").when(unit_text.isNotNull(), "m")
    header = F.when(header_units.isin("mm", "cm", "m", "inches", "feet"), header_units) if header_units is not None else F.lit(None).cast("string")
    unit = F.coalesce(header, said)
    return F.struct(
        value.alias("value"),
        unit.alias("unit"),
        F.when(value.isNotNull() | unit.isNotNull(), "amber").otherwise("red").alias("confidence"),
        F.when(value.isNotNull(), "title_block_text").when(header.isNotNull(), "dxf_header").when(unit.isNotNull(), "title_block_text").otherwise("not_detected").alias("source"),
        (F.size(ratios) > 1).alias("ambiguous"),
    )


def block_class(text) -> Column:
    """What a line of text is by its words alone."""
    t = F.trim(text, F.lit(" \t\n"))
    like = lambda p: F.regexp_like(t, _ci(p))
    any_of = lambda ps: F.regexp_like(t, _ci("|".join(f"(?:{p})" for p in ps)))
    return F.when(t == "", "UNKNOWN").when(like(NOTES_LINE), "NOTES").when(like(KEY_PLAN), "KEY_PLAN").when(any_of(FLOOR_LABELS), "FLOOR_LABEL").when(any_of(ROOM_LABELS), "ROOM_LABEL").when(like(DIMENSION_LINE), "DIMENSION").otherwise("UNKNOWN")


def in_title_zone(x0, top, width, height) -> Column:
    return (x0 > width * 0.65) | (top > height * 0.70)


def unfenced(text) -> Column:
    """JSON without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def error_kind(text) -> Column:
    low = F.lower(text)
    has = lambda *w: F.exists(F.array(*[F.lit(x) for x in w]), lambda x: F.contains(low, x))
    return F.when(has("429", "quota"), "quota").when(has("404", "deprecated"), "model").when(has("timeout"), "timeout").otherwise("other")
