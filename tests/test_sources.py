"""Readers, writers, components and scalar functions on small fixtures."""

import csv
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from stockloom.functions import geometry as g
from stockloom.functions import text
from stockloom.operators import detections, ledger
from stockloom.operators.graph import connected_components
from stockloom.sources import documents, sinks


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_truth_document(spark, tmp_path):
    doc = {"affine": [[1, 0, 0, 0, 1, 0]] * 3, "holds": [[0.0, 1.5]], "pause": [2.0, 3.0], "frame_size": [640, 480], "fps": 30, "px_per_m": 500.0, "objects": [{"id": 1, "cls": "can", "sku": "c1", "box": [1, 2, 3, 4]}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=1))
    d = documents.truth_document(spark, f"{tmp_path}/t.json")
    assert [tuple(r) for r in documents.truth_objects(d).collect()] == [(1, "can", "c1", 1.0, 2.0, 3.0, 4.0)]
    assert documents.truth_affines(d).count() == 3 and documents.truth_holds(d).first().t_to == 1.5


def test_view_truth_takes_the_last_line(spark, tmp_path):
    (tmp_path / "v.csv").write_text("commit,class,count\n1, can ,3\n1,can,4\n2,case,1\n")
    assert sorted(tuple(r) for r in documents.view_truth(spark, f"{tmp_path}/v.csv").collect()) == [(1, "can", 4), (2, "case", 1)]


def test_catalogue_flags_duplicates(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Code;Name\n001;A\n002;B\n001;C\n")
    got = documents.catalogue(spark, f"{tmp_path}/c.csv", {"Code": "code", "Name": "name"}, ";").collect()
    assert sorted((r.code, r.duplicate) for r in got) == [("001", True), ("001", True), ("002", False)]


def test_detection_cache(spark, tmp_path):
    dets = spark.createDataFrame([("v", "d", 0.3, 1, 0.9)], "video string, detector string, shown double, frame int, score double")
    documents.write_cache(dets, f"{tmp_path}/cache")
    cache = spark.read.parquet(f"{tmp_path}/cache")
    missing = documents.missing_frames(spark.createDataFrame([(1,), (2,)], "frame int"), cache, "v", "d", 0.3)
    assert [r.frame for r in missing.collect()] == [2]


def test_folder_size(spark, tmp_path):
    (tmp_path / "m" / "n").mkdir(parents=True)
    (tmp_path / "m" / "a.bin").write_bytes(b"123")
    (tmp_path / "m" / "n" / "b.bin").write_bytes(b"4567")
    assert tuple(documents.folder_size(spark, f"{tmp_path}/m").first()) == (2, 7)


def lines(spark):
    return spark.createDataFrame([("Z", "0012", "=SUM(A1)", 3, 1, 7, 'say "hi"; bye')], "zone string, sku_code string, sku_name string, units_per_case int, full_cases int, total_units int, notes string")


def test_csv_export(spark, tmp_path):
    sinks.write_csv(lines(spark), f"{tmp_path}/out")
    (part,) = (tmp_path / "out").glob("part-*.txt")
    raw = part.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfsession_id;") and b"\r\n" in raw
    row = list(csv.DictReader(io.StringIO(raw.decode("utf-8-sig")), delimiter=";"))[0]
    assert row["sku_code"] == "0012" and row["sku_name"] == "'=SUM(A1)" and row["notes"] == 'say "hi"; bye' and row["total_units"] == "7"


def test_xlsx_export(spark):
    z = zipfile.ZipFile(io.BytesIO(sinks.xlsx_bytes(lines(spark))))
    sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "'=SUM(A1)" in sheet and "<v>7</v>" in sheet and ">0012<" in sheet


def test_coco_and_summary_documents(spark):
    images = spark.createDataFrame([(1, "a.jpg")], "id long, file_name string")
    boxes = spark.createDataFrame([(2, 1, 1), (1, 1, 1)], "id long, image_id long, category_id long")
    cats = spark.createDataFrame([(1, "can")], "id long, name string")
    got = json.loads(sinks.coco_document(images, boxes, cats).first().value)
    assert [a["id"] for a in got["annotations"]] == [1, 2] and got["categories"][0]["name"] == "can"
    commits = spark.createDataFrame([(2, 1.5), (1, 0.5)], "n long, t double")
    totals = spark.createDataFrame([("d", "can", 4)], "detector string, cls string, n long")
    got = json.loads(sinks.summary_json({"hold": "0.8"}, commits, totals).first().value)
    assert [c["n"] for c in got["commits"]] == [1, 2] and json.loads(got["totals"]["d"]) == {"can": 4}
    assert sinks.markdown_table(cats) == "| id | name |\n|---|---|\n| 1 | can |\n"


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 9), (7, 7), (None, 1), (3, 2), (20, 19), (19, 18), (18, 20)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8, 18: 18, 19: 18, 20: 18}
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(e.where("a > 100")).count() == 0


def test_text_functions(spark):
    assert one(spark, text.gtin_check_digit(F.lit("629104150021")))[0] == 3
    assert one(spark, text.gtin14(F.lit("629104150021")))[0] == "06291041500213"
    assert one(spark, text.percent_error(F.lit(72), F.lit(82)), text.percent_error(F.lit(1), F.lit(0))) == ("-12%", "n/a")
    assert one(spark, text.escape_cell(F.lit("@x")), text.escape_cell(F.lit("x@"))) == ("'@x", "x@")
    assert one(spark, text.literal_table(F.lit("bottle=120, case = 8")))[0] == {"bottle": 120, "case": 8}


def test_geometry(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    inf = one(spark, g.angular_speed(F.lit(float("nan")), F.lit(500.0), F.lit(0.1), F.lit(0.03)))[0]
    assert inf == float("inf")
    assert one(spark, g.iou(lit(0, 0, 2, 2), lit(1, 0, 3, 2)))[0] == 2 / 6
    assert one(spark, g.coverage(lit(0, 0, 2, 2), lit(1, 0, 3, 2)))[0] == 0.5
    square = [lit(0, 0), lit(10, 0), lit(10, 10), lit(0, 10)]
    assert one(spark, g.in_convex(*lit(10, 5), square), g.in_convex(*lit(5, 5), square[::-1]), g.in_convex(*lit(11, 5), square)) == (True, True, False)
    assert one(spark, g.view_status(lit(0, 5, 9, 9), *lit(100, 100, 0.5, 10)), g.view_status(lit(5, 5, 15, 15), *lit(100, 100, 0.5, 10)), g.view_status(lit(2, 2, 12, 12), *lit(100, 100, 0.5, 10))) == ("cut", "inner", "band")
    good = g.plausible_registration(*lit(40, 160), F.lit(True), *lit(1, 0.5, 0.1))
    bad = g.plausible_registration(*lit(39, 100), F.lit(True), *lit(1, 0.5, 0.1))
    assert one(spark, good, bad, g.plausible_fit(*lit(1, 0.1)), g.plausible_fit(*lit(0.5, 0))) == (True, False, True, False)
    assert round(one(spark, g.view_advance(*lit(320, 0, 640, 480)))[0], 6) == 0.5


def test_lifecycle(spark):
    e = spark.createDataFrame([(1, i, a) for i, a in enumerate(["finish", "lock", "reopen", "resume", "finish", "finish"])], "s int, i int, action string")
    assert [(r.i, r.state) for r in ledger.lifecycle_errors(e, "s", ["i"], "action").collect()] == [(5, "review")]
    middle = spark.createDataFrame([(1, 0, "lock"), (1, 1, "finish"), (1, 2, "lock"), (2, 0, "finish"), (2, 1, "finish"), (2, 2, "resume")], "s int, i int, action string")
    assert sorted((r.s, r.i, r.state) for r in ledger.lifecycle_errors(middle, "s", ["i"], "action").collect()) == [(1, 0, "open"), (2, 1, "review")]


def test_gaps_count_the_ends(spark):
    from stockloom.operators import motion

    c = spark.createDataFrame([(1, 1, 10.0), (1, 2, 12.0), (1, 3, 15.0), (2, 1, 4.0)], "walk_id int, n int, t double")
    got = {r.walk_id: (r.max_gap, r.median_gap) for r in motion.gap_summary(c, F.lit(0.0), F.lit(16.0)).collect()}
    assert got == {1: (10.0, 2.5), 2: (12.0, None)}


def test_written_truth_is_read_back(spark, tmp_path):
    objects = spark.createDataFrame([(2, "can", "c2", [1, 2, 3, 4]), (1, "case", "c1", [5, 6, 7, 8])], "id int, cls string, sku string, box array<int>")
    affines = spark.createDataFrame([(1, [1.0, 0.0, 5.0, 0.0, 1.0, 0.0]), (0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "frame int, m array<double>")
    holds = spark.createDataFrame([(3.0, 4.0), (0.0, 1.5)], "t_from double, t_to double")
    doc = sinks.truth_document(objects, affines, holds, (2.0, 3.0), (640, 480), 30, 500.0)
    (tmp_path / "t.json").write_text(doc.first().value)
    d = documents.truth_document(spark, f"{tmp_path}/t.json")
    assert [r.id for r in documents.truth_objects(d).collect()] == [1, 2] and [r.m[2] for r in documents.truth_affines(d).orderBy("frame").collect()] == [0.0, 5.0]
    assert documents.truth_holds(d).orderBy("hold").first().t_to == 1.5 and d.first().pause == [2.0, 3.0]


def test_small_documents_and_their_bounds(spark):
    kinds = spark.createDataFrame([("conv", 1, 3), ("topk", 2, 1), ("conv", 2, 4)], "kind string, depth int, n long")
    assert json.loads(sinks.inventory_json(kinds).first().value) == {"conv": 7, "topk": 1}
    with pytest.raises(ValueError):
        sinks.markdown_table(spark.range(5), max_rows=4)


def test_unknown_classes_are_an_error(spark):
    ok = text.known_classes(text.literal_table(F.lit("can=1, case = 2")), ("can", "case"))
    assert one(spark, ok)[0] == {"can": 1, "case": 2}
    with pytest.raises(Exception, match="unknown class: crate"):
        one(spark, text.known_classes(text.literal_table(F.lit("can=1, crate = 2")), ("can", "case")))


def test_no_shared_folder_is_an_error_on_a_cluster(spark):
    from types import SimpleNamespace

    from stockloom.plans import durable

    lone = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        durable.shared_dir(lone)


def test_average_precision_of_hand_made_views(spark):
    box = "commit_id long, cls string, det_id long, score double, x0 double, y0 double, x1 double, y1 double"
    truth = spark.createDataFrame([(1, "a", 1, 1.0, 0.0, 0.0, 10.0, 10.0), (1, "a", 2, 1.0, 20.0, 0.0, 30.0, 10.0), (1, "b", 3, 1.0, 0.0, 0.0, 10.0, 10.0), (2, "c", 1, 1.0, 0.0, 0.0, 1.0, 1.0)], box)
    shown = spark.createDataFrame([
        (1, "a", 11, 0.9, 0.0, 0.0, 10.0, 10.0), (1, "a", 12, 0.9, 0.0, 0.0, 10.0, 9.0),  # one truth, the same score: the smaller id finds it
        (1, "a", 13, 0.5, 20.0, 0.0, 30.0, 10.0), (1, "a", 14, 0.7, 50.0, 50.0, 60.0, 60.0), (1, "b", 15, 0.4, 40.0, 0.0, 50.0, 10.0), (2, "a", 16, 0.3, 0.0, 0.0, 10.0, 10.0),
    ], box)
    hits = detections.box_hits(shown, truth, 0.5)
    assert {r.det_id for r in hits.where("hit = 1").collect()} == {11, 13} and hits.count() == 6
    per = ledger.average_precision(hits, truth.groupBy("cls").agg(F.count("*").alias("positives")), "cls", "hit", "score")
    assert {r.cls: (r.shown, r.hits, r.positives, r.ap) for r in per.collect()} == {"a": (5, 2, 2, 0.5), "b": (1, 0, 1, 0.0), "c": (0, 0, 1, 0.0)}


def test_regrouped_merges_splits_and_undo(spark):
    items = spark.createDataFrame([(i, i % 5) for i in range(10)], "item long, grp long")
    merges = spark.createDataFrame([(4, 2), (2, 1), (2, 1)], "a long, b long")
    splits = spark.createDataFrame([(7,), (7,)], "item long")
    got = {r["item"]: r["grp"] for r in ledger.regrouped(items, merges, splits).collect()}
    assert got == {i: {0: 0, 1: 1, 2: 1, 3: 3, 4: 1}[i % 5] for i in range(10)} | {7: None}
    undone = {r["item"]: r["grp"] for r in ledger.regrouped(items, merges.limit(0), splits.limit(0)).collect()}
    assert undone == {i: i % 5 for i in range(10)}
