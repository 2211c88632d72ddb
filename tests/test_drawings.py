"""Golden cases of the drawing, page, merge, geometry, graph and stream operators."""

import re

import pytest
from pyspark.sql import functions as F

from emberplan.functions import text as tx
from emberplan.operators import geometry as ge
from emberplan.operators import graph as gr
from emberplan.operators import merge as mg
from emberplan.operators import pages as pg
from emberplan.sources.files import dxf_entities, uploads
from emberplan.streaming.admission import admit, admit_stream, page_log, windowed_counts


def one(spark, column, *values, schema="text STRING"):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


TEXT = "text"


def test_fields_of_text(spark):
    t = "BUILDING HEIGHT = 18.5 m\nNO. OF FLOORS = 6\nKITCHEN\nSPRINKLER SYSTEM PROPOSED"
    assert one(spark, tx.height(TEXT), t) == 18.5
    assert one(spark, tx.storeys(TEXT), t) == 6
    assert one(spark, tx.storeys(TEXT), "G + 4") == 5
    assert one(spark, tx.mentions(TEXT, r"\bkitchen\b"), t) is True
    assert one(spark, tx.mentions(TEXT, r"\bkitchen\b"), "none") is None
    assert one(spark, tx.height(TEXT), "HEIGHT = 900 m, 12 m ht") == 12.0
    assert one(spark, tx.occupancy(TEXT)["code"], "a small workshop") == "F-2"
    assert one(spark, tx.height(TEXT), None) is None


def test_areas_claim_their_span(spark):
    a = one(spark, tx.areas(TEXT), "FLOOR AREA = 450 sqm\nBASEMENT AREA = 380 sqm\n1 BASEMENT LEVEL\n77 sq.m")
    assert [(x["label"], x["value"]) for x in a] == [("basement_area", 380.0), ("floor_area", 450.0), ("generic_area", 77.0)]


@pytest.mark.parametrize(
    ("text", "value", "confidence", "ambiguous"),
    [("SCALE 1:100", "1:100", "amber", False), ("DO NOT SCALE THE DRAWING", None, "red", False), ("SCALE 1 CM = 2.00 MT", "1:200", "amber", False), ("SCALE 1:200 KEY PLAN SCALE 1:2000", "1:200", "amber", True)],
)
def test_scale(spark, text, value, confidence, ambiguous):
    r = one(spark, tx.scale(TEXT), text)
    assert (r["value"], r["confidence"], r["ambiguous"]) == (value, confidence, ambiguous)


def test_names_and_blocks(spark):
    assert one(spark, tx.ocr_project_name(TEXT), "SHEET CLIENT ROYAL LANDMARK HOTEL PROJECT DWG NO DATE NORTH") == "ROYAL LANDMARK HOTEL"
    assert one(spark, tx.ocr_project_name(TEXT), "DEVELOPER, OWNER FROM THEIR RESPONSIBILITIES") is None
    assert one(spark, tx.project_name(TEXT), "PROJECT: Test Towers\nMumbai, Maharashtra") == "Test Towers"
    assert one(spark, tx.first_listed(TEXT, tx.CITIES), "Mumbai, Maharashtra") == "Mumbai"
    for t, c in (("GROUND FLOOR PLAN", "FLOOR_LABEL"), ("KITCHEN", "ROOM_LABEL"), ("NOTES: x", "NOTES"), ("KEY PLAN", "KEY_PLAN"), ("3500 mm", "DIMENSION"), ("abc", "UNKNOWN"), ("  ", "UNKNOWN")):
        assert one(spark, tx.block_class(TEXT), t) == c
    assert one(spark, tx.in_title_zone(F.lit(900.0), F.lit(950.0), F.lit(1000.0), F.lit(1000.0)), "") is True
    assert one(spark, tx.labels(TEXT, tx.FLOOR_LABELS), "ground   floor, F 2, Ground Floor") == ["F 2", "GROUND FLOOR"]
    assert one(spark, tx.unfenced(TEXT), '```json\n{"k": 1}\n```') == '{"k": 1}'


def test_pages(spark):
    cls = lambda *v: one(spark, pg.page_class(*map(F.lit, v)), "")
    assert [cls(0, 0.0, 300, 0), cls(0, 0.0, 10, 1), cls(0, 0.0, 0, 0), cls(50, 0.2, 0, 0), cls(50, 0.0, 900, 0)] == ["MIXED", "IMAGE_ONLY", "SCANNED", "POOR_TEXT", "NATIVE_TEXT"]
    assert [one(spark, pg.quality(F.lit(x)), "") for x in (0.95, 0.90, 0.80, 0.75, 0.50)] == ["GOOD", "GOOD", "REVIEW", "REVIEW", "BAD"]
    sparse = [["a", "b"] + [None] * 9] + [[""] * 11] * 43
    assert [one(spark, pg.table_passes(F.col("r")), r, schema="r ARRAY<ARRAY<STRING>>") for r in (sparse, [["a"] * 3] * 2, [["a"] * 103] * 59)] == [False, True, False]
    a = spark.createDataFrame([(1, 0, "psm3", 0.99), (1, 1, "psm6", 0.10), (2, 0, "psm3", 0.40), (2, 1, "psm6", 0.70), (2, 2, "psm11", 0.60)], "id INT, ordinal INT, config STRING, score DOUBLE")
    assert {r["id"]: (r["config"], r["attempts"]) for r in pg.best_attempt(a).collect()} == {1: ("psm3", 1), 2: ("psm6", 3)}
    rows = [["FLOOR", "AREA SQ.M"], ["Ground Floor", "120.5"], ["", "5"], ["F 2", "80"]]
    assert [tuple(x) for x in one(spark, pg.floor_areas_of_table(F.col("r"), tx.FLOOR_LABELS), rows, schema="r ARRAY<ARRAY<STRING>>")] == [("GROUND FLOOR", 120.5), ("F 2", 80.0)]


def test_merge(spark):
    a = spark.createDataFrame([(1, 9.0, None, [1.0], ["B"]), (2, None, None, [], [])], "id INT, height DOUBLE, floors INT, areas ARRAY<DOUBLE>, labels ARRAY<STRING>")
    b = spark.createDataFrame([(1, 5.0, 4, [2.0], ["A", "B"]), (3, 3.0, None, [], [])], "id INT, height DOUBLE, floors INT, areas ARRAY<DOUBLE>, labels ARRAY<STRING>")
    m = {r["id"]: r for r in mg.merge(a, b, "id", ["height", "floors"], ["areas"], ["labels"]).collect()}
    assert (m[1]["height"], m[1]["height_source"], m[1]["floors"], m[1]["floors_source"], m[1]["areas"], m[1]["labels"]) == (9.0, "first", 4, "second", [1.0, 2.0], ["A", "B"])
    assert m[2]["height"] is None and m[3]["height"] == 3.0


def test_regions_and_graphs(spark):
    room = [(1, r, c) for r in range(2, 6) for c in range(2, 6)] + [(1, r, c) for r in range(8, 10) for c in range(8, 10)] + [(1, 0, 0)]
    px = spark.createDataFrame(room, "page LONG, row INT, col INT")
    assert sorted((r["size"], r["r0"], r["c1"]) for r in gr.regions(px, 20, 20, 4).collect()) == [(4, 8, 9), (16, 2, 5)]
    assert gr.regions(px, 20, 20, 17).count() == 0
    assert {(r["row"], r["col"]) for r in gr.opened(px.where("row < 6 and row > 0"), 1).collect()} <= {(r, c) for _, r, c in room}
    e = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 4, 1.0), (1, 3, 5, 9.0), (1, 2, 6, 9.0)], "grp LONG, src LONG, dst LONG, length DOUBLE")
    d = {(r["src"], r["dst"]): r["dist"] for r in gr.shortest_paths(e).collect()}
    assert d[1, 4] == 3.0 and d[6, 5] == 19.0 and d[1, 1] == 0.0
    places = gr.cover(e, 2.0).collect()
    assert sum(r["covers"] for r in places) == 6 and all(any(d[p["node"], n] <= 2.0 for p in places) for n in range(1, 7))
    w = {(r["src"], r["dst"]) for r in gr.walkable(e, 2.0).collect()}
    assert all(1 not in x and 4 not in x for x in w)


def test_contraction_and_pruning(spark):
    def walk(edges, prune):
        e = spark.createDataFrame([(1, *x) for x in edges], "grp LONG, src LONG, dst LONG, length DOUBLE")
        return {(r["src"], r["dst"], r["length"]) for r in gr.walkable(e, prune).collect()}

    # Junctions 5 and 6 joined by two chains, an arm each: the shorter chain stays as an edge.
    two = [(5, 1, 2.0), (1, 6, 2.0), (5, 2, 4.0), (2, 3, 1.0), (3, 6, 1.0), (5, 8, 9.0), (6, 9, 7.0)]
    assert walk(two, 1.0) == {(5, 6, 4.0), (5, 8, 9.0), (6, 9, 7.0)}
    # A loop at a junction goes, the arms stay.
    assert walk([(5, 1, 2.0), (1, 2, 2.0), (2, 5, 2.0), (5, 8, 9.0), (5, 9, 7.0)], 1.0) == {(5, 8, 9.0), (5, 9, 7.0)}
    # Short branches fall round by round; a chain of its own that is short falls whole.
    tree = [(1, 2, 1.0), (2, 3, 1.0), (2, 4, 20.0), (4, 5, 20.0), (4, 6, 30.0), (50, 51, 1.0), (51, 52, 1.0)]
    assert walk(tree, 2.0) == {(4, 5, 20.0), (4, 6, 30.0), (2, 4, 20.0)}
    assert walk([(50, 51, 1.0), (51, 52, 1.0)], 2.0) == set() and walk([(50, 51, 1.0), (51, 52, 1.0)], 1.5) == {(50, 52, 2.0)}


def test_page_classes(spark):
    from emberplan.operators import pages as pg

    rows = [(1, "", 300, 0), (2, "\x01" * 9 + "some of a text that is", 0, 0), (3, "abc", 0, 1), (4, "abc", 0, 0), (5, "a whole page of text", 0, 0)]
    x = spark.createDataFrame(rows, "k INT, text STRING, paths INT, images INT")
    x = x.select("k", "paths", "images", *pg.signals(F.col("text"), F.lit(1000.0), F.lit(800.0)))
    got = {r["k"]: r["c"] for r in x.withColumn("c", pg.page_class(F.col("text_len"), F.col("garbage_ratio"), F.col("paths"), F.col("images"))).collect()}
    assert got == {1: "MIXED", 2: "POOR_TEXT", 3: "IMAGE_ONLY", 4: "SCANNED", 5: "NATIVE_TEXT"}


def test_points(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 500.0, 500.0), (2, 3, 0.0, 0.0)], "grp LONG, id LONG, x DOUBLE, y DOUBLE")
    b = spark.createDataFrame([(1, 7, 3.0, 4.0, "HALL"), (1, 8, -3.0, 4.0, "LIFT"), (1, 9, 200.0, 0.0, "FAR")], "grp LONG, jd LONG, bx DOUBLE, by DOUBLE, text STRING")
    assert {r["id"]: (r["text"], r["dist"]) for r in ge.nearest(a, b, 200.0, "none").collect()} == {1: ("HALL", 5.0), 2: ("none", None), 3: ("none", None)}
    assert {r["id"]: round(r["dist"], 3) for r in ge.nearest_distance(a, b.drop("text"), 100.0).collect()} == {1: 5.0, 2: 583.095, 3: float("inf")}
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 6.0, 0.0), (1, 3, 50.0, 0.0)], "k INT, ordinal INT, x DOUBLE, y DOUBLE")
    assert [(r["cluster"], r["x"], r["n"]) for r in ge.clusters(p, "k", 4.0).orderBy("cluster").collect()] == [(0, 1.5, 2), (1, 6.0, 1), (2, 50.0, 1)]
    s = spark.createDataFrame([(1, v) for v in (10.0, 10.1, 10.2, 99.0)], "k INT, v DOUBLE")
    r = ge.robust_mean(s, "k", "v").first()
    assert (r["kept"], r["rejected"], r["confidence"]) == (3, 1, "green")


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.bin").write_bytes(b"AC1015" + b"0" * 100)
    got = {r["path"].rsplit("/", 1)[1]: (r["route"], r["accepted"]) for r in uploads(spark, str(tmp_path), 50).collect()}
    assert got == {"a.pdf": ("pdf", True), "b.bin": ("unsupported", False)}
    dxf = "0\nSECTION\n2\nENTITIES\n0\nPOLYLINE\n8\nW\n10\n0\n20\n0\n70\n1\n0\nVERTEX\n10\n1\n20\n2\n0\nVERTEX\n10\n3\n20\n4\n0\nSEQEND\n0\nENDSEC\n"
    r = dxf_entities(spark.createDataFrame([(1, dxf), (2, None), (3, "garbage")], "id LONG, content STRING")).collect()
    assert [(x["kind"], x["closed"], [tuple(p) for p in x["points"]]) for x in r] == [("POLYLINE", True, [(1.0, 2.0), (3.0, 4.0)])]


def requests():
    return [(1, i, t) for i, t in enumerate([0, 1, 2, 60, 61, 62, 63, 500, 501, 560])] + [(2, 100, 5)]


def test_admission(spark):
    x = spark.createDataFrame(requests(), "key LONG, id LONG, t LONG")
    got = {r["id"]: (r["accepted"], r["retry_after_us"]) for r in admit(x, 60, 2).collect()}
    assert [got[i][0] for i in range(10)] == [True, True, False, False, True, True, False, True, True, False]
    assert got[2][1] == 58 and got[3][1] == 0 and got[100][0]  # exactly one window old still counts


def test_streams(spark, tmp_path):
    x = spark.createDataFrame(requests(), "key LONG, id LONG, t LONG")
    x.write.parquet(str(tmp_path / "in"))
    q = admit_stream(spark.readStream.schema(x.schema).parquet(str(tmp_path / "in")), 60, 2).writeStream.format("memory").queryName("admitted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("admitted").select("id", "accepted", "retry_after_us").collect())) == sorted(map(tuple, admit(x, 60, 2).select("id", "accepted", "retry_after_us").collect()))
    e = spark.sql("SELECT timestamp'2020-01-01 01:00:00' ts, 'a' event_type, 1.0D value UNION ALL SELECT timestamp'2020-01-02 02:00:00', 'a', 2.0D")
    e.write.parquet(str(tmp_path / "ev"))
    q = windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").count() == windowed_counts(e).count() == 2
    page_log(spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev")), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_regions_against_flood_fill(spark):
    import random

    rng = random.Random(7)
    # Pages over several Arrow batches, repeated pixels, gaps of rows, a page that is full but for its border.
    px = {(p, rng.randrange(14), rng.randrange(14)) for p in range(40) for _ in range(90)} | {(99, r, c) for r in range(1, 30) for c in range(1, 30)} | {(7, 40, 3), (8, 0, 3)}
    want, left = set(), set(px)
    while left:
        part, todo = [], [left.pop()]
        while todo:
            p, r, c = todo.pop()
            part.append((r, c))
            near = {(p, r + i, c + j) for i, j in gr.EIGHT} & left
            left -= near
            todo += near
        rows, cols = [x[0] for x in part], [x[1] for x in part]
        if len(part) >= 3 and min(rows) > 0 and min(cols) > 0 and max(rows) < 49 and max(cols) < 49:
            first = min(part)
            want.add((p, first[0] * 100_000 + first[1], len(part), min(rows), min(cols), max(rows), max(cols)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        out = gr.regions(spark.createDataFrame([*px, (7, 40, 3)], "page LONG, row INT, col INT"), 50, 50, 3)
        assert {tuple(r) for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def _built(df) -> list[str]:
    """Of each broadcast of a plan, the operators below it."""
    found, lines = [], df._jdf.queryExecution().sparkPlan().toString().split("\n")
    for i, line in enumerate(lines):
        m = re.search(r"(\w*HashJoin|\w*LoopJoin) .*(BuildLeft|BuildRight)", line)
        if m and "Broadcast" in m[1]:
            depth = next(k for k, ch in enumerate(line) if ch.isalpha())
            sides = [k for k in range(i + 1, len(lines)) if lines[k].strip() and next((j for j, ch in enumerate(lines[k]) if ch.isalpha()), 0) == depth + 3]
            at = sides[0 if m[2] == "BuildLeft" else 1]
            stop = next((k for k in range(at + 1, len(lines)) if next((j for j, ch in enumerate(lines[k]) if ch.isalpha()), 0) <= depth + 3), len(lines))
            found.append("\n".join(lines[at:stop]))
    return found


@pytest.mark.parametrize("name", ["g9_rays", "g10_scale", "a24_validation_report", "j13_nearest", "j15_pair_points"])
def test_exploded_rows_are_never_broadcast(spark, name):
    from emberplan.plans import registry

    registry.load()
    out = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    sides = _built(out)
    assert not [x for x in sides if "Generate" in x], sides
