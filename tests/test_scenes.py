"""Overlap of views, proposals, indexed search, teaching, late and limited streams, table functions, workbooks, robust fits."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stockloom.functions import geometry as g
from stockloom.operators import detections as d
from stockloom.operators import detectors, index, ledger, registration
from stockloom.plans import scenes
from stockloom.sources import workbooks
from stockloom.streaming import triggers

SF = "/root/testdata/sf0.001"


def test_shared_area_of_convex_quads_equals_sampling(spark):
    rng = np.random.default_rng(5)

    def quad():  # corners at sorted angles around a centre, either way round
        at = np.sort(rng.uniform(0, 2 * np.pi, 4)) if rng.random() < 2 else None
        pts = rng.uniform(30, 70, 2) + np.stack([np.cos(at), np.sin(at)], 1) * rng.uniform(15, 40)
        return pts if rng.random() < 0.5 else pts[::-1]

    pairs = [(quad(), quad()) for _ in range(30)]
    names = [f"{s}{k}{c}" for s in "pq" for k in range(4) for c in "xy"]
    rows = spark.createDataFrame([tuple(map(float, np.concatenate([a.ravel(), b.ravel()]))) for a, b in pairs], ", ".join(f"{n} double" for n in names)).coalesce(1)
    side = lambda s: [(F.col(f"{s}{k}x"), F.col(f"{s}{k}y")) for k in range(4)]
    got = [r[0] for r in rows.select(g.convex_overlap(side("p"), side("q"))).collect()]
    xy = np.stack(np.meshgrid(np.arange(-20, 120, 0.25), np.arange(-20, 120, 0.25)), -1).reshape(-1, 2)

    def inside(poly):
        e = np.roll(poly, -1, 0) - poly
        turn = e[:, 0] * (xy[:, None, 1] - poly[:, 1]) - e[:, 1] * (xy[:, None, 0] - poly[:, 0])
        return (turn >= 0).all(1) | (turn <= 0).all(1)

    want = [(inside(a) & inside(b)).sum() * 0.0625 for a, b in pairs]
    assert np.allclose(got, want, atol=8) and max(got) > 500 and min(got) < 1


def test_quads_are_cut_batch_by_batch(spark):
    """Three squares either way round, apart and with an unknown corner; no expression over arrays of corners is left in the plan."""
    from stockloom.functions import polygons

    box = lambda x, y, size: [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    sets = [(box(0, 0, 10), box(5, 0, 10)[::-1], box(0, 4, 20)), (box(0, 0, 10), box(20, 0, 5), box(0, 0, 9)), (box(0, 0, 10), box(0, 0, 10), box(0, 0, 10)[::-1]), (box(0, 0, 1), [(None, 0)] * 4, box(0, 0, 1))]
    names = [f"{s}{k}{c}" for s in "pqr" for k in range(4) for c in "xy"]
    rows = spark.createDataFrame([tuple(v if v is None else float(v) for quad in s for point in quad for v in point) for s in sets], ", ".join(f"{n} double" for n in names)).coalesce(1)
    side = lambda s: [(F.col(f"{s}{k}x"), F.col(f"{s}{k}y")) for k in range(4)]
    assert [r[0] for r in rows.select(polygons.shared_area(side("p"), side("q"), side("r"))).collect()] == [30.0, 0.0, 100.0, None]
    plan = scenes.view_overlaps(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_frequent_words_are_split_not_dropped(spark):
    rng = np.random.default_rng(2)
    rows = [(1, n, [1.0, 1.0, *map(float, rng.choice([-1, 1], 4))]) for n in range(40)] + [(2, n, [1.0, -1.0, 1.0, 1.0, 1.0, 1.0]) for n in range(3)]
    df = spark.createDataFrame(rows, "walk_id long, n long, v array<double>")
    whole = {(r.walk_id, r.a, r.b) for r in registration.proposed_pairs(registration.posting_words(df, 2, 4, 1000)).collect()}
    split = {(r.walk_id, r.a, r.b) for r in registration.proposed_pairs(registration.posting_words(df, 2, 4, 10)).collect()}
    assert len([p for p in whole if p[0] == 1]) == 40 * 39 // 2
    same = {(1, a, b) for a in range(40) for b in range(a + 1, 40) if rows[a][2] == rows[b][2]}
    assert {p for p in split if p[0] == 1} == same and {p for p in split if p[0] == 2} == {p for p in whole if p[0] == 2}


def test_index_finds_what_exact_search_finds(spark):
    from stockloom.sources.tables import table

    v = table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    exact = {(r.q, r["rank"], r.g) for r in d.knn(v.where("id % 20 = 0"), v, 3).collect()}
    centres = index.fit_centres(v, scenes.LISTS)
    assert {(r.q, r["rank"], r.g) for r in index.knn_indexed(v.where("id % 20 = 0"), v, centres, 3, scenes.LISTS).collect()} == exact
    some = scenes.knn_indexed(spark, SF).collect()
    pairs = {(q, g_) for q, _, g_ in exact}
    assert len({(r.q, r.g) for r in some} & pairs) >= 0.95 * len(pairs) and len(some) == len(exact)


def test_recall_on_grouped_vectors_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 50)
    rng = np.random.default_rng(9)
    mid = rng.normal(size=(30, 24))
    x = mid[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    centres = index.fit_centres(v, 32)
    probes = index.calibrated_probes(v, centres, 3, 0.97)
    assert probes <= 16  # grouped vectors need few lists
    got = index.knn_indexed(v.where("id % 20 = 0"), v, centres, 3, probes).collect()
    sim = x[::20] @ x.T
    sim[np.arange(75), np.arange(0, 1500, 20)] = -2
    want = {(20 * i, int(j)) for i, row in enumerate(np.argsort(-sim, axis=1)[:, :3]) for j in row}
    assert len({(r.q, r.g) for r in got} & want) >= 0.95 * len(want)


def test_what_is_taught_later_is_not_suggested_before(spark, tmp_path):
    path = f"file://{tmp_path}/examples"
    one = [float(i == 0) for i in range(4)]
    ledger.teach(spark.createDataFrame([(7, 42, one, 3)], "group_id long, code long, v array<float>, session long"), path)
    ledger.teach(spark.createDataFrame([(8, 43, one, 5)], "group_id long, code long, v array<float>, session long"), path)
    ex = ledger.examples(spark, path).select(F.col("group_id").alias("id"), "v", F.col("session").alias("at"), "code")
    asks = spark.createDataFrame([(100 + s, one, s) for s in (3, 4, 6)], "id long, v array<float>, at long")
    got = index.knn_indexed(asks, ex, index.fit_centres(ex, 4), 2, 4).collect()
    assert sorted((r.q, r.g) for r in got) == [(104, 7), (106, 7), (106, 8)]  # session 3 knows nothing of itself, 4 not of 5


def test_late_rows_are_dropped_and_counted(spark):
    got = scenes.late_rows(spark, SF).collect()
    assert sum(r.late for r in got) > 0 and sum(r.repeated for r in got) > 0
    assert all(r.kept + r.late + r.repeated <= r.fed for r in got)


def test_limited_stream_takes_few_files_at_a_time(spark, tmp_path):
    rows = spark.range(700).withColumn("kind", F.col("id") % 3)
    rows.repartition(7).write.parquet(f"{tmp_path}/in")
    sizes = [spark.read.parquet(str(f)).count() for f in (tmp_path / "in").glob("part-*")]
    src = triggers.limited(spark, rows.schema, f"{tmp_path}/in", files=2)
    q = src.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    batches = triggers.taken(q)
    assert len(batches) == 4 and sum(n for _, n in batches) == 700 and max(n for _, n in batches) <= 2 * max(sizes)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 700


def test_detectors_by_name_in_sql(spark):
    detectors.register(spark)
    spark.createDataFrame([(1, 10.0, 10.0, 20.0, 20.0, 0.4), (2, 50.0, 10.0, 63.0, 20.0, 0.9), (3, 1.0, 1.0, 2.0, 2.0, None)], "k long, x0 double, y0 double, x1 double, y1 double, score double").createOrReplaceTempView("some_boxes")
    got = spark.sql("SELECT * FROM detector(TABLE(some_boxes), 'rfdetr')")
    assert got.columns == ["k", "x0", "y0", "x1", "y1", "score", "counted"] and sorted((r.k, r.counted) for r in got.collect()) == [(1, False), (2, True)]
    assert spark.sql("SELECT k FROM detector(TABLE(some_boxes), 'rfdetr_tiled')").collect() == [(1,)]
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM detector(TABLE(some_boxes), 'other')")


def test_workbooks_round_trip(spark, tmp_path):
    rows = [(str(i), None if i % 5 == 0 else f"näme & <{i}> \" x", "=1+1" if i % 2 else "") for i in range(57)]
    df = spark.createDataFrame(rows, "code string, `Item name` string, note string").repartition(3)
    assert workbooks.write_workbooks(df, f"file://{tmp_path}/w", per_file=10).agg(F.sum("rows")).first()[0] == 57
    got = workbooks.read_workbooks(spark, f"file://{tmp_path}/w")
    assert got.columns == df.columns and len(list((tmp_path / "w").glob("*.xlsx"))) >= 6
    assert sorted(map(tuple, got.collect())) == sorted((a, b, c or None) for a, b, c in rows)  # blank cells are null
    assert workbooks.read_workbooks(spark, f"file://{tmp_path}/w", {"Item name": "name"}).columns == ["name"]


def test_workbooks_of_the_export_are_read(spark, tmp_path):
    from stockloom.sources import sinks

    lines = spark.createDataFrame([("z1", "c1", "5", "note, with comma")], "zone string, sku_code string, total_units string, notes string")
    (tmp_path / "a.xlsx").write_bytes(sinks.xlsx_bytes(lines))
    got = workbooks.read_workbooks(spark, f"file://{tmp_path}/a.xlsx").collect()
    assert [(r.zone, r.sku_code, r.total_units, r.notes) for r in got] == [("z1", "c1", "5", "note, with comma")]


@pytest.mark.parametrize("many", [10, 200])
def test_a_third_of_wrong_matches_does_not_move_the_fit(spark, many):
    rng = np.random.default_rng(many)
    p = rng.uniform(0, 100, (many, 2))
    q = np.stack([1.1 * p[:, 0] - 0.2 * p[:, 1] + 4, 0.2 * p[:, 0] + 1.1 * p[:, 1] - 7], 1) + rng.normal(0, 0.05, (many, 2))
    bad = rng.permutation(many)[: int(0.3 * many)]
    q[bad] += rng.uniform(10, 60, (len(bad), 2))
    rows = [(1, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(p, q, strict=True))] + [(2, 0, 1.0, 1.0, 2.0, 2.0), (2, 1, 1.0, 1.0, 2.0, 2.0)]
    got = registration.robust_fits(spark.createDataFrame(rows, "zone long, id long, px double, py double, qx double, qy double"), ["zone"], 0.5).orderBy("zone").collect()
    assert np.allclose([got[0].a, got[0].b, got[0].x, got[0].y], [1.1, 0.2, 4, -7], atol=0.15) and got[0].agree == many - len(bad)
    assert (got[1].matches, got[1].agree, got[1].a) == (2, 0, None)


def test_stronger_links_win_over_clashing_ones(spark):
    rows = [(1, 5, 1, 90, []), (1, 5, 2, 80, [1, 3]), (1, 5, 3, 70, [2]), (1, 6, 1, 50, [2])]
    got = registration.consistent_links(spark.createDataFrame(rows, "walk_id long, commit_n long, a long, inliers long, foes array<long>")).collect()
    assert sorted((r.commit_n, r.a, r.inliers) for r in got) == [(5, 1, 90), (5, 3, 70), (6, 1, 50)]


def test_queries_of_a_list_are_dealt_in_blocks_too(spark, monkeypatch):
    """However many rows ask in one list, a task's group holds about a block of them; the result stays that of the exact search."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    v = spark.createDataFrame([(i, (r / np.linalg.norm(r)).tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    seen, real = [], index.dealt
    monkeypatch.setattr(index, "BLOCK", 32)
    monkeypatch.setattr(index, "dealt", lambda df, keys: (seen.append((df, keys)), real(df, keys))[1])
    got = {(r.q, r["rank"], r.g) for r in index.knn_indexed(v, v, index.fit_centres(v, 1), 3, 1).collect()}
    assert got == {(r.q, r["rank"], r.g) for r in d.knn(v, v, 3).collect()}
    df, keys = seen[0]
    assert df.where("side = 0").groupBy(*keys).count().agg(F.max("count")).first()[0] <= 64


def test_detector_counts_make_the_boxes_once(spark):
    """The boxes of all detectors come from one written table, not from a join of the lines for each."""
    from stockloom.plans import review

    plan = review.detector_counts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "l_partkey" not in plan


def test_groups_of_equal_size_are_fitted_together():
    rnd = np.random.default_rng(8)
    for n in (1, 2, 3, 6, 9):
        p = rnd.uniform(0, 90, (30, n, 2))
        p[0] = p[0, :1]  # no two different points
        q = p @ np.array([[1.02, 0.05], [-0.05, 1.02]]) + [4, -7] + np.where(rnd.uniform(size=(30, n, 1)) < 0.3, rnd.uniform(20, 60, (30, n, 2)), 0)
        fits, agree = registration.consensus_many(p, q, 0.5)
        for k in range(30):
            found = registration.consensus(p[k], q[k], 0.5)
            if found is None:
                assert np.isnan(fits[k]).all() and agree[k] == 0
            else:
                assert fits[k] == pytest.approx(found[0], abs=1e-9) and agree[k] == found[1].sum()


def test_postings_read_the_descriptors_once(spark):
    """Copies of a descriptor count once; a frequent word is split, a rare one is not; neither takes a second pass over the descriptors."""
    rows = [(1, n, [1.0, 1.0, s]) for n in (1, 1, 2, 3) for s in (1.0, 1.0, -1.0)] + [(1, 4, [-1.0, 1.0, s]) for s in (1.0, -1.0)]
    d = spark.createDataFrame(rows, "walk_id long, n long, v array<double>")
    got = registration.posting_words(d, 2, 1, 2)
    assert sorted(tuple(r) for r in got.collect()) == [*((1, n, w) for n in (1, 2, 3) for w in (14, 15)), (1, 4, 1)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_detectors_of_a_schema_take_batches(spark):
    """Batch by batch the table function gives what it gives row by row, and the query makes its boxes once."""
    rows = [(i, 40.0 + i % 30, 30.0 + i % 17, 60.0 + i % 7, 44.0 + i % 9, None if i % 11 == 0 else i % 10 / 10) for i in range(300)]
    boxes = spark.createDataFrame(rows, "k long, x0 double, y0 double, x1 double, y1 double, score double")
    boxes.createOrReplaceTempView("odd_boxes")
    got = []
    for schema in (None, boxes.schema):
        detectors.register(spark, schema)
        got.append([sorted(map(tuple, spark.sql(f"SELECT * FROM detector(TABLE(odd_boxes), '{n}')").collect())) for n in detectors.names()])
    assert got[0] == got[1] and all(got[0])
    with pytest.raises(Exception, match="no detector"):
        spark.sql("SELECT * FROM detector(TABLE(odd_boxes), 'other')").collect()
    plan = scenes.detectors_in_sql(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "l_orderkey" not in plan
