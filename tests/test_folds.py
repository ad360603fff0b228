"""Folds are held to hand-made walks, brute force on small groups and invariants."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stockloom.operators import commits, counting, detections, folds, graph
from stockloom.plans import detections as sheets
from stockloom.plans import folds as plans

SF = "/root/testdata/sf0.001"


def walk(n=100, dt=0.1, speed=lambda t: 1.0, dx=lambda t: 0.0, lost=lambda t: False, sharp=lambda t: 1.0):
    t = [round(i * dt, 6) for i in range(n)]
    return pd.DataFrame([{"frame": i, "t": x, "speed": speed(x), "dx": dx(x), "dy": 0.0, "lost": lost(x), "sharp": sharp(x)} for i, x in enumerate(t)])


def test_hold_fires_once_until_the_view_turns():
    got = commits.run_trigger(walk(), 0.1, {})
    assert [(c["n"], round(c["t"], 3), c["hold_from"]) for c in got] == [(1, 0.8, 0.0)]
    turned = walk(dx=lambda t: 60.0 if t == 2.0 else 0.0)  # 60 px at a focal length of 500: 6.8 degrees
    got = commits.run_trigger(turned, 0.1, {})
    assert len(got) == 2 and got[1]["hold_from"] == pytest.approx(2.0) and got[1]["step_deg"] > 5


def test_lost_tracking_rearms_and_hides_the_step():
    got = commits.run_trigger(walk(lost=lambda t: 2.0 <= t < 2.1, speed=lambda t: np.inf if 2.0 <= t < 2.1 else 1.0), 0.1, {})
    assert len(got) == 2 and got[1]["step_deg"] is None


def test_hold_takes_the_sharpest_frame_of_its_window():
    got = commits.run_trigger(walk(sharp=lambda t: 5.0 if abs(t - 0.3) < 1e-9 else 1.0), 0.1, {})
    assert got[0]["t_key"] == pytest.approx(0.3)


def test_timed_trigger_restarts_where_it_fires():
    got = commits.run_trigger(walk(), 0.1, {"every": 2.0})
    assert np.allclose([c["t"] for c in got], [1.9, 3.9, 5.9, 7.9, 9.9])  # the first window opens a frame early


def test_sweep_commits_each_half_view_and_waits_for_slow_frames():
    moving = walk(dx=lambda t: 16.0)  # 640 px wide: half a view in 20 frames
    assert len(commits.run_trigger(moving, 0.1, {"sweep": 0.5})) >= 5
    assert not commits.run_trigger(moving, 0.1, {"sweep": 0.5, "sweep_speed": 0.5})


def test_fallback_flags_views_without_a_hold():
    fast = walk(dx=lambda t: 16.0, speed=lambda t: 20.0)
    got = commits.run_trigger(fast, 0.1, {"fallback": 0.7, "sweep_speed": 30.0})
    assert got and all(c["no_hold"] for c in got)
    assert not commits.run_trigger(fast, 0.1, {})


def test_conflicting_triggers_are_rejected():
    with pytest.raises(ValueError):
        commits.Trigger(every=2.0, sweep=0.5)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_the_cheapest(n, m, rnd):
    cost = np.array([[rnd.randint(0, 20) for _ in range(m)] for _ in range(n)], float)
    i, j = folds.assign(cost)
    assert len(i) == min(n, m) == len(set(i)) == len(set(j))
    small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
    best = min(sum(cost[a, b] if n <= m else cost[b, a] for a, b in zip(small, p, strict=True)) for p in itertools.permutations(large, len(small)))
    assert cost[i, j].sum() == pytest.approx(best)


BOX = "x0 y0 x1 y1".split()


def count(spark, rows, links, *options, **more):
    """Statuses by (commit, detection); links: (from, to) -> transform, inliers."""
    dets = spark.createDataFrame(pd.DataFrame(rows))
    tied = [(1, a, b, [float(x) for x in np.asarray(h).ravel()], n) for (a, b), (h, n) in links.items()]
    got = counting.count_commits(dets, spark.createDataFrame(tied, "walk_id long, a long, b long, h array<double>, inliers long"), *options, **more).collect()
    assert len(got) == len(rows)
    return {(r.n, r.det_id): r.status for r in got}


def at(x, wide=10.0):
    return dict(zip(BOX, (x, 40.0, x + wide, 50.0), strict=True))


def test_counting_with_links_prompts_and_never_double_counts(spark):
    rows = [dict(walk_id=1, n=1, t=0.0, det_id=i, score=0.9, cls="can", **at(30.0 + 12 * i)) for i in range(4)]
    rows += [dict(walk_id=1, n=2, t=1.0, det_id=i, score=0.9, cls="can", **at(20.0 + 12 * i)) for i in range(4)]  # the view moved by 10
    rows += [dict(walk_id=1, n=2, t=1.0, det_id=9, score=0.9, cls="bottle", **at(50.0)), dict(walk_id=1, n=2, t=1.0, det_id=10, score=0.1, cls="can", **at(50.0)), dict(walk_id=1, n=2, t=1.0, det_id=11, score=0.9, cls="can", **at(-2.0))]
    by = count(spark, rows, {(1, 2): ([[1, 0, -10], [0, 1, 0], [0, 0, 1]], 60)}, 0.5, 100.0, 100.0, 0.5, 12.0)
    assert [by[1, i] for i in range(4)] == ["new"] * 4 and [by[2, i] for i in range(4)] == ["seen"] * 4
    assert (by[2, 9], by[2, 10], by[2, 11]) == ("miss", "low", "cut")
    alone = count(spark, rows, {}, 0.5, 100.0, 100.0, 0.5, 12.0)
    assert list(alone.values()).count("new") == 9  # without links every view counts anew


def view_pairs(dets, items):
    """Matches (detection, item) of boxes with classes."""
    side = lambda rows: (np.array([b for _, b in rows], float), np.array([k for k, _ in rows], object))
    return sorted(zip(*map(np.ndarray.tolist, counting.view_matches(*side(dets), *side(items))), strict=True))


def test_common_offset_needs_support_and_takes_the_shortest():
    box = [("can", (20 + 12 * i, 40, 30 + 12 * i, 50)) for i in range(4)]
    moved = lambda by, many=4: [(k, (a + by, b + by, c + by, d + by)) for k, (a, b, c, d) in box[:many]]
    assert view_pairs(box, moved(4)) == [(i, i) for i in range(4)]  # 5.7 px off: past half a box, reached by an offset
    assert view_pairs(box[:2], moved(4, 2)) == []  # two are too few to vote
    assert view_pairs(box, moved(2)) == [(i, i) for i in range(4)] and view_pairs(box, [("bottle", b) for _, b in moved(2)]) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.randoms(use_true_random=False))
def test_matches_are_the_cheapest_of_the_largest(n, m, rnd):
    spot = lambda: [rnd.randint(0, 30), rnd.randint(0, 10)]
    a, b = np.array([spot() for _ in range(n)], float), np.array([spot() for _ in range(m)], float)
    far = np.hypot(*((a[:, None] - b[None]) / 10).transpose(2, 0, 1))
    det, item = np.nonzero(far <= 1)
    got = list(zip(*counting.cheapest_matches(det, item, far[det, item]), strict=True))
    best = min((sum(-1000 + far[i, j] for i, j in zip(range(n), p, strict=False) if j >= 0 and far[i, j] <= 1) for p in itertools.permutations([*range(m), *[-1] * n], n)), default=0)
    assert sum(-1000 + far[i, j] for i, j in got) == pytest.approx(best) and len({i for i, _ in got}) == len(got) == len({j for _, j in got})


def test_zone_follows_its_items(spark):
    base = np.array([[0, 0], [10, 0], [10, 10], [0, 10], [5, 5.0]])
    turn = np.array([[0.98, -0.1], [0.1, 0.98]])

    def fit(then, now):
        rows = lambda xy, x, y: spark.createDataFrame([(1, 1, i, float(a), float(b)) for i, (a, b) in enumerate(xy)], f"walk_id long, zone long, item long, {x} double, {y} double")
        got = counting.moved_zones(rows(then, "cx", "cy"), rows(now, "ix", "iy").drop("zone"), ["walk_id", "zone"]).collect()
        return np.array(got[0].h).reshape(3, 3) if got else None

    assert np.allclose(fit(base, base @ turn.T + [3, -2]), [[0.98, -0.1, 3], [0.1, 0.98, -2], [0, 0, 1]])
    assert np.allclose(fit(base, 3 * base)[:2, :2], np.eye(2))  # too large a scale: the median shift
    assert np.allclose(fit(base[:2], base[:2] + 4), [[1, 0, 4], [0, 1, 4], [0, 0, 1]])


@pytest.mark.parametrize("motion", [False, True])
def test_supersteps_equal_the_fold(spark, motion):
    """Random walks whose views shift and turn a little, with wrong links, gaps and detections that come and go."""
    import walk_fold

    rng, rows, tied = np.random.default_rng(7 + motion), [], []
    for w in range(12):
        shelf = rng.integers(0, [300, 80], (25, 2)).astype(float)
        kind, at, t = rng.choice(["can", "bottle"], 25), 0.0, 0.0
        starts = []
        for n in range(1, 8):
            at, t = at + float(rng.integers(0, 60)), t + float(rng.integers(1, 20))
            starts.append(at)
            for i, (x, y) in enumerate(shelf):
                x0, y0 = x - at + rng.integers(-3, 4), y + rng.integers(-2, 3)
                if -15 < x0 < 130 and rng.random() < 0.9:
                    rows.append({"walk_id": w, "n": n, "t": t, "det_id": i, "x0": x0, "y0": y0, "x1": x0 + 14, "y1": y0 + 12, "score": float(rng.choice([0.3, 0.9, 0.95])), "cls": str(kind[i])})
            for a in range(1, n):
                if rng.random() < (0.8 if a == n - 1 else 0.3):
                    wrong = rng.random() < 0.15
                    tied.append((w, a, n, [1.0, 0.001, starts[a - 1] - at + (50 if wrong else 2), -0.001, 1.0, 1.0, 0.0, 0.0, 1.0], int(rng.integers(40, 45))))
    dets = spark.createDataFrame(pd.DataFrame(rows))
    links = spark.createDataFrame(tied, "walk_id long, a long, b long, h array<double>, inliers long")
    options = (0.5, 130.0, 100.0, 1.0, 12.0)
    got = {(r.walk_id, r.n, r.det_id): r.status for r in counting.count_commits(dets, links, *options, motion=motion, dead_reckon=25.0).collect()}
    from pyspark.sql import functions as F

    from stockloom.functions import geometry as g
    from stockloom.operators.detections import status

    placed = dets.withColumn("place", status(F.col("score"), g.box(), *options)).toPandas()
    want = walk_fold.statuses(placed, links.toPandas(), 130.0, 100.0, 12.0, motion, 25.0)
    assert got == want and {"new", "seen", "miss", "edge", "cut", "low"} == set(want.values())


def test_tracked_items_are_seen_again_and_zones_move_along(spark):
    rows = [dict(walk_id=1, n=n, t=float(n), det_id=i, score=0.9, cls="can", **at(40.0 + 12 * i - 6 * n)) for n in (1, 2, 3) for i in range(4)]
    rows.append(dict(walk_id=1, n=3, t=3.0, det_id=9, score=0.9, cls="case", **at(50.0)))
    step = ([[1, 0, -6], [0, 1, 0], [0, 0, 1]], 50)
    by = count(spark, rows, {(1, 2): step, (2, 3): step}, 0.5, 100.0, 100.0, 0.5, 12.0, motion=True)
    assert all(by[n, i] == ("new" if n == 1 else "seen") for n in (1, 2, 3) for i in range(4)) and by[3, 9] == "miss"


@pytest.mark.parametrize("motion", [False, True])
def test_no_superstep_reads_what_all_earlier_ones_have_seen(spark, monkeypatch, motion):
    from pyspark.sql import DataFrameReader

    rows = [dict(walk_id=1, n=n, t=float(n), det_id=i, score=0.9, cls="can", **at(40.0 + 12 * i)) for n in (1, 2, 3, 4) for i in range(4)]
    whole, reads = DataFrameReader.parquet, []
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **more: reads.append([p for p in paths if "/step=" in p]) or whole(self, *paths, **more))
    by = count(spark, rows, {(1, 3): (np.eye(3), 50), (2, 4): (np.eye(3), 50)}, 0.5, 100.0, 100.0, 0.5, 12.0, motion=motion)
    assert [by[n, 0] for n in (1, 2, 3, 4)] == ["new", "seen" if motion else "new", "seen", "seen"]
    assert max(map(len, reads[:-1])) == 1 and len(reads[-1]) == 4  # the last read is the result
    best = counting._best_sightings(np.array([5, 3, 5, 5, 3]), np.array([40, 50, 60, 60, 50]), np.array([1, 2, 2, 3, 1]))
    assert best.tolist() == [1, 3]


def test_walk_query_keeps_its_invariants(spark):
    got = plans.counted_walks(spark, SF).toPandas()
    assert set(got.status) <= {"new", "seen", "miss", "edge", "cut", "low"}
    assert len(got) == len(got.drop_duplicates(["walk_id", "n", "det_id"]))
    seen = got[got.status == "seen"].groupby("walk_id").n.min()
    first = got[got.status == "new"].groupby("walk_id").n.min()
    assert (first.reindex(seen.index) < seen).all()  # only counted items are seen again
    opening = got[got.n == 1]
    assert not set(opening.status) & {"seen", "miss"}


def test_streamed_statuses_are_those_of_the_batch(spark):
    got = plans.streamed_statuses(spark, SF)
    assert got.count() == 6000 and got.exceptAll(plans.counted_walks(spark, SF)).isEmpty()


def test_idle_walks_are_forgotten_and_others_are_not(spark, tmp_path):
    """A walk that comes back after its state has expired is counted anew; with a longer time its items are seen again."""
    from pyspark.sql import functions as F

    from stockloom.streaming import walks

    day = lambda n: 86_400 * (n + 100)
    dets = [(w, n, i, 20.0 + 12 * i, 40.0, 30.0 + 12 * i, 50.0, 0.9, "can", t) for w, n, t in ((1, 1, day(0)), (2, 1, day(20)), (2, 2, day(40)), (1, 2, day(41))) for i in range(4)]
    d = spark.createDataFrame(dets, "walk_id long, n long, det_id long, x0 double, y0 double, x1 double, y1 double, score double, cls string, s long").withColumn("ts", F.timestamp_seconds("s"))
    same = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    links = spark.createDataFrame([(1, 1, 2, same, 50), (2, 1, 2, same, 50)], "walk_id long, a long, b long, h array<double>, inliers long")
    rows = walks.commit_rows(d, links, 0.5, 100.0, 100.0, 0.5, 12.0)

    def run(expire, name):
        for low, high in ((0, 10), (10, 30), (30, 40.5), (40.5, 50)):
            rows.where(F.unix_timestamp("ts").between(int(day(low)), int(day(high)) - 1)).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            src = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/{name}/in")
            q = walks.stream_statuses(src, 100.0, 100.0, 12.0, expire=expire).writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        return {(r.walk_id, r.n): r.status for r in spark.read.parquet(f"{tmp_path}/{name}/out").where("det_id = 1").collect()}

    assert run("25 days", "short") == {(1, 1): "new", (2, 1): "new", (2, 2): "seen", (1, 2): "miss"}  # asked about, but no item is known any more
    assert run("100 days", "long") == {(1, 1): "new", (2, 1): "new", (2, 2): "seen", (1, 2): "seen"}


def test_suppression_leaves_no_overlap_and_drops_only_overlapped(spark):
    from stockloom.sources.adapters import detections

    d = detections(spark, SF)
    kept = folds.suppress(d, 0.2).toPandas()
    everything = d.toPandas()
    for commit, g in everything.groupby("commit_id"):
        k = kept[kept.commit_id == commit]
        iou = folds.box_iou(g[["x0", "y0", "x1", "y1"]].to_numpy(), k[["x0", "y0", "x1", "y1"]].to_numpy())
        for row, hit in zip(g.itertuples(), iou >= 0.2, strict=True):
            others = k[hit & (k.det_id.to_numpy() != row.det_id)]
            assert others.empty if row.det_id in set(k.det_id) else (others.score >= row.score).any()


def test_stream_equals_batch(spark):
    key = ["walk_id", "n"]
    a = plans.hold_trigger(spark, SF).toPandas().sort_values(key).reset_index(drop=True)
    b = plans.streamed_commits(spark, SF).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


def test_streamed_windows_are_the_closed_batch_windows(spark):
    a = {tuple(r) for r in plans.streamed_windows(spark, SF).collect()}
    b = {tuple(r) for r in plans.batch_windows(spark, SF).collect()}
    assert a and a <= b
    assert {r[0] for r in b - a} == {max(r[0] for r in b)}  # only the last day is still open


def test_assigned_groups_equal_brute_force(spark):
    rows = [(1, 1, 10, 20, 3.0), (1, 1, 10, 21, 1.0), (1, 1, 11, 21, 1.5), (2, 5, 30, 40, 2.0), (2, 5, 30, 41, 2.5), (2, 5, 31, 40, 9.0)]
    got = folds.assigned_groups(spark.createDataFrame(rows, "walk_id long, grp long, det long, item long, dist double")).collect()
    assert sorted((r.walk_id, r.matches, r.cost) for r in got) == [(1, 2, 4.5), (2, 2, 11.5)]


def test_idle_walks_leave_the_state(spark, tmp_path):
    """Without expiry the second part of a walk goes on counting from the first; with it the walk begins anew."""
    from stockloom.streaming import triggers

    start = pd.Timestamp("2024-01-01")
    first = walk().assign(walk_id=1)
    late = pd.concat([walk().assign(walk_id=2, t=lambda f: f.t + 500), walk(n=1).assign(walk_id=2, t=900.0)])
    again = walk().assign(walk_id=1, t=lambda f: f.t + 1000)

    def commits(expire, name):
        out = f"{tmp_path}/{name}"
        for part in (first, late, again):
            part = part.assign(ts=start + pd.to_timedelta(part.t, unit="s"))
            spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(f"{out}/in")
            src = spark.readStream.schema(spark.read.parquet(f"{out}/in").schema).parquet(f"{out}/in")
            q = triggers.stream_commits(src, 0.1, expire=expire).writeStream.foreachBatch(triggers.exactly_once(f"{out}/got", ["walk_id", "n", "t"])).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        return sorted((r.walk_id, r.n) for r in spark.read.parquet(f"{out}/got").collect())

    assert commits("10 seconds", "short").count((1, 1)) == 2 and commits("1 day", "long").count((1, 1)) == 1


def test_neighbouring_walks_share_an_entry_of_the_state(spark, tmp_path):
    """Forty walks, the last without an id, take four entries; each counts on from its own frames in the last part and is dropped when it is due itself."""
    from pyspark.sql import functions as F

    from stockloom.streaming import triggers

    start, walks_ = pd.Timestamp("2024-01-01"), list(range(39))
    part = lambda shift, of: pd.concat([walk().assign(walk_id=k, t=lambda f, k=k: f.t + shift + k) for k in of])
    parts = [part(0, walks_), part(400, [500]), part(1000, walks_[::2])]  # the second moves the watermark

    def run(expire, name):
        out, used = f"{tmp_path}/{name}", []
        for p in parts:
            rows = spark.createDataFrame(p.assign(ts=start + pd.to_timedelta(p.t, unit="s"))).withColumn("walk_id", F.expr("if(walk_id = 38, null, walk_id)"))
            rows.coalesce(1).write.mode("append").parquet(f"{out}/in")
            src = spark.readStream.schema(rows.schema).parquet(f"{out}/in")
            q = triggers.stream_commits(src, 0.1, expire=expire).writeStream.foreachBatch(triggers.exactly_once(f"{out}/got", ["walk_id", "n", "t"])).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
            q.awaitTermination()
            used.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        got = spark.read.parquet(f"{out}/got").toPandas()
        return used, got.groupby(got.walk_id.fillna(-1)).n.apply(sorted).to_dict()

    used, kept = run("1 day", "kept")
    assert used == [4, 5, 5] and len(kept) == 40 and all(v == [1] for v in kept.values())
    _, anew = run("100 seconds", "anew")
    assert anew[0] == anew[36] == anew[-1] == [1, 1] and anew[1] == anew[37] == anew[500] == [1]


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    from stockloom.streaming import triggers

    write = triggers.exactly_once(f"{tmp_path}/out", ["k"])
    for _ in range(2):
        write(spark.createDataFrame([(1,), (1,), (2,)], "k long"), 7)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_detectors_go_by_name(spark):
    from stockloom.operators import detectors

    boxes = spark.createDataFrame([(10.0, 10.0, 20.0, 20.0, 0.4), (50.0, 10.0, 63.0, 20.0, 0.9)], "x0 double, y0 double, x1 double, y1 double, score double")
    assert [r.counted for r in detectors.detector("rfdetr")(boxes).orderBy("score").collect()] == [False, True]
    assert detectors.detector("rfdetr_tiled")(boxes).count() == 1 and detectors.detector("oracle")(boxes).count() == 1
    with pytest.raises(ValueError):
        detectors.detector("other")


def test_a_batch_of_a_walk_calls_the_state_a_few_times():
    """Twelve linked commits in one batch: one read and one write of the items, and no timer but the first."""
    from stockloom.streaming import walks

    calls = []

    class State:
        def __init__(self):
            self.held = {}

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("updateValue", "update"):
                    self.held[args[0] if name == "updateValue" else None] = args[-1]
                return self.held.get(args[0] if args else None) if name in ("getValue", "get") else None if name not in ("exists", "containsKey") else (args[0] if args else None) in self.held

            return call

    handle, state = State(), State()
    handle.getMapState = lambda *a, **k: state
    handle.getValueState = lambda *a, **k: State()
    times = type("T", (), {"getCurrentWatermarkInMs": lambda s: -1, "getCurrentProcessingTimeInMs": lambda s: 0})()
    counter = walks.WalkCounter(100.0, 100.0, 12.0, 1000, None)
    counter.init(handle)
    same = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    xs = [20.0, 32.0, 44.0, 56.0]
    commit = lambda n: (1, n, n, [1, 2, 3, 4], ["can"] * 4, ["inner"] * 4, xs, [40.0] * 4, [x + 10 for x in xs], [50.0] * 4, [n - 1] if n > 1 else None, [50], [same])
    got = [(r["n"], r["status"]) for r in counter.handleInputRows((1,), iter([commit(n) for n in range(1, 13)]), times)]
    assert got == [(n, "new" if n == 1 else "seen") for n in range(1, 13) for _ in range(4)]
    assert calls.count("getValue") == 1 and calls.count("updateValue") == 1 and len(calls) <= 5


def test_items_go_to_few_cells_and_all_within_reach_meet(spark):
    places = [(i, (i * 37 % 101) * 0.5 - 20, (i * 53 % 97) * 0.5 - 9) for i in range(150)]
    items = spark.createDataFrame([(1, i, x, y) for i, x, y in places], "k long, item long, ix double, iy double")
    points = spark.createDataFrame([(1, i, y, x) for i, x, y in places], "k long, p long, px double, py double")
    got = detections.near_items(points, items, ["k"], "px", "py", 3.0).where("abs(px - ix) <= 3 AND abs(py - iy) <= 3").select("p", "item").collect()
    assert sorted(map(tuple, got)) == sorted((p, i) for p, py, px in places for i, x, y in places if abs(px - x) <= 3 and abs(py - y) <= 3)
    assert items.select(detections._cells("ix", 3.0)).count() < 2 * len(places)


def test_votes_of_many_offsets_equal_brute_force(spark):
    dets = [(1, f"d{i}", "ab"[i % 2], i * 7.0 % 40, i * 3.0 % 30, i % 3) for i in range(12)]
    items = [(1, "ab"[i % 2], i * 11.0 % 41, i * 5.0 % 29, i % 3) for i in range(12)]
    cands = [(1, 2.0 * i, 2.0 * j) for i in range(-6, 7) for j in range(-6, 7)]
    frames = (spark.createDataFrame(rows, schema) for rows, schema in ((dets, "walk_id long, det_id string, cls string, cx double, cy double, sku long"), (items, "walk_id long, cls string, ix double, iy double, item_sku long"), (cands, "walk_id long, dx double, dy double")))
    got = {(r.dx, r.dy): r.votes for r in detections.offset_votes(*frames, ["walk_id"], 4.0, 13.0).collect()}
    expected = {}
    for _, dx, dy in cands:
        near = [min(((np.hypot(x + dx - ix, y + dy - iy), s != t) for _, c, ix, iy, t in items if c == cls), default=(9, 0)) for _, _, cls, x, y, s in dets]
        votes = sum(0.5 if differs else 1.0 for far, differs in near if far <= 4)
        expected |= {(dx, dy): votes} if votes else {}
    assert got == expected


def test_strategy_grid_and_votes_read_the_detections_once(spark):
    for name in ("q75_strategy_grid", "q30_offset_votes"):
        assert "lineitem" not in (plans.QUERIES | sheets.QUERIES)[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_contracted_edges_are_stars_of_the_same_components(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(10, 60)] + [(2, 100 - i, 99 - i) for i in range(20)], "w long, a long, b long")
    stars = graph.contracted(edges.coalesce(1), "a", "b", ["w"])
    assert {tuple(r) for r in graph.connected_components(stars).collect()} == {tuple(r) for r in graph.connected_components(edges).collect()}
    assert len({r.b for r in stars.where("w = 2" if "w" in stars.columns else "a > 70").collect()}) == 1


def test_small_and_large_assignments_agree(monkeypatch):
    rnd = np.random.default_rng(5)
    costs = [np.where(c > 15, folds.FORBIDDEN, np.round(c)) for c in (rnd.uniform(0, 20, rnd.integers(1, 9, 2)) for _ in range(60))]
    small = [folds.assign(c) for c in costs]
    monkeypatch.setattr(folds, "SMALL", -1)
    assert all((np.array(a) == np.array(folds.assign(c))).all() for a, c in zip(small, costs, strict=True))


def test_boxes_of_many_commits_are_suppressed_together():
    rnd = np.random.default_rng(3)
    low = rnd.integers(0, 12, (40, 6, 2))
    boxes = np.concatenate([low, low + rnd.integers(1, 12, (40, 6, 2))], 2).astype(float)
    for own, kept in zip(boxes, folds.kept_boxes(boxes, 0.3), strict=True):
        expected = []
        for i in range(6):
            if not expected or folds.box_iou(own[i : i + 1], own[expected]).max() < 0.3:
                expected.append(i)
        assert np.flatnonzero(kept).tolist() == expected


def test_frames_are_warped_once_and_not_for_each_detection(spark):
    dets = spark.createDataFrame([(1, 1, 20.0, 20.0, 30.0, 30.0), (1, 2, 0.0, 0.0, 4.0, 4.0)], "walk_id long, det_id long, x0 double, y0 double, x1 double, y1 double")
    frames = spark.createDataFrame([(1, list(counting.IDENTITY))], "walk_id long, h array<double>")
    got = counting.frames_over(dets, frames, 130.0, 100.0, 12.0)
    assert [tuple(r) for r in got.collect()] == [(1, 1)]
    join = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftSemi" in x]
    assert len(join) == 1 and "[6]" not in join[0]


def test_blockers_make_the_views_once(spark):
    """Lines are read for what was counted and for views without counts, not a second time for views with them."""
    from stockloom.plans import ledger

    plan = ledger.review_blockers(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in plan.splitlines() if "Relation" in x and "l_orderkey" in x]) == 2


def test_walks_of_a_call_are_counted_side_by_side():
    """Thirty walks in one call of the state: its reads and writes are those of one walk, and each walk is counted as if it were alone."""
    from stockloom.streaming import walks

    class Held:
        def __init__(self):
            self.rows, self.calls = {}, 0

        def getValue(self, k):
            self.calls += 1
            return self.rows.get(k)

        def updateValue(self, k, row):
            self.calls += 1
            self.rows[k] = row

        get, update = (lambda self: self.getValue(0)), (lambda self, row: self.updateValue(0, row))

    rnd = np.random.default_rng(11)

    def commit(w, n):
        many, before = int(rnd.integers(1, 7)), [m for m in range(1, n) if rnd.random() < 0.5]
        x, y = rnd.integers(5, 80, (2, many)).astype(float)
        h = [[1.0, 0.0, float(rnd.integers(-4, 5)), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0] for _ in before]
        box = [list(c) for c in (x, y, x + 25, y + 20)]
        return (w, n, n, list(range(many)), [str(c) for c in rnd.choice(["can", "case"], many)], [str(p) for p in rnd.choice(["inner", "inner", "band", "low"], many)], *box, before or None, [int(i) for i in rnd.integers(40, 43, len(before))] or None, h or None)

    all_, times = [commit(w, n) for w in range(30) for n in range(1, 21)], type("T", (), {"getCurrentWatermarkInMs": lambda s: -1, "getCurrentProcessingTimeInMs": lambda s: 0})()

    def run(*groups):
        out, calls = [], 0
        for own in groups:
            seen, due = Held(), Held()
            counter = walks.WalkCounter(130.0, 100.0, 12.0, 1000, None)
            counter.init(type("H", (), {"getMapState": lambda s, *a, seen=seen, **k: seen, "getValueState": lambda s, *a, due=due, **k: due, "registerTimer": lambda s, t: None})())
            for low, high in ((1, 8), (9, 20)):  # two batches, and commits on both sides of an entry
                out += [tuple(r) for r in counter.handleInputRows((own[0],), iter([c for c in all_ if c[0] in own and low <= c[1] <= high]), times)]
            calls = max(calls, seen.calls)
        return sorted(out), calls

    together, calls = run(list(range(30)))
    alone, calls_of_one = run(*([w] for w in range(30)))
    assert together == alone and calls <= calls_of_one <= 6 and {"new", "seen", "miss", "edge", "low"} == {r[-1] for r in together}


def test_commits_side_by_side_match_as_alone(monkeypatch):
    rnd = np.random.default_rng(4)
    monkeypatch.setattr(counting, "TOGETHER", 50)
    box = lambda n: np.hstack([low := rnd.integers(0, 30, (n, 2)).astype(float), low + rnd.integers(4, 30, (n, 2))])
    kind = lambda n: rnd.choice(np.array(["can", "case", None], object), n)
    views = [(box(n), kind(n), box(m), kind(m)) for n, m in rnd.integers(0, 8, (60, 2))]
    at, there_at = (np.repeat(np.arange(60), [len(v[k]) for v in views]) for k in (0, 2))
    got = set(zip(*(x.tolist() for x in counting.view_matches(*(np.concatenate(c) for c in zip(*views, strict=True)), at, there_at)), strict=True))
    low, there_low = np.searchsorted(at, np.arange(60)), np.searchsorted(there_at, np.arange(60))
    assert got == {(int(i + a), int(j + b)) for v, a, b in zip(views, low, there_low, strict=True) for i, j in zip(*counting.view_matches(*v), strict=True)} and len(got) > 30
    assert len(counting.cheapest_matches(np.array([0, 0, 1, 5]), np.array([7, 8, 7, 9]), np.array([0.2, 0.9, 0.9, 0.1]))[0]) == 3


def test_moves_in_batches_are_those_of_the_expressions(spark):
    """Boxes, chained transforms and frames bit for bit; what has no transform stays, and a view without links is not asked about."""
    from pyspark.sql import functions as F

    from stockloom.functions import geometry as g
    from stockloom.functions import transforms

    rnd = np.random.default_rng(2)
    rows = [(i, None if i % 7 == 0 else [float(x) for x in np.eye(3).ravel() + rnd.uniform(-0.01, 0.01, 9) + [0, 0, 20 * (i % 3), 0, 0, 5, 0, 0, 0]], *map(float, (x, y, x + 15, y + 9))) for i, (x, y) in enumerate(rnd.integers(0, 80, (60, 2)))]
    d = spark.createDataFrame(rows, "walk_id long, h array<double>, x0 double, y0 double, x1 double, y1 double").withColumn("det_id", F.col("walk_id"))
    h = F.col("h")
    got = d.select("walk_id", "h", transforms.moved_box(h, g.box()).alias("b"), transforms.chained(h, h).alias("c"), F.array(*g.warp_box(h, g.box())).alias("want")).collect()
    for r in (r for r in got if r.h is not None):
        m = np.array(r.h).reshape(3, 3)
        assert list(r.b) == r.want and r.c == [m[i, 0] * m[0, j] + m[i, 1] * m[1, j] + m[i, 2] * m[2, j] for i in range(3) for j in range(3)]
    placed = d.withColumns({"t": F.lit(1.0), "cls": F.lit("can"), "place": F.lit("inner")})
    frames, frame = d.where("h is not null").select("walk_id", "h"), np.array([[12.0, 118.0, 118.0, 12.0], [12.0, 12.0, 88.0, 88.0]])
    status = {r.walk_id: r.status for r in counting._finished(placed, None, frames, 2, frame).collect()}
    over = {r.walk_id for r in counting.frames_over(d, frames, 130.0, 100.0, 12.0).collect()}
    assert status == {r[0]: "miss" if r[0] in over else "new" for r in rows} and 5 < len(over) < 50


def test_zones_are_fitted_in_one_pass(spark):
    """Items meet the zones' once, and the sums of a zone come from the shuffle that its means come from; commits' times are made before the steps."""
    then = spark.createDataFrame([(1, 1, i, float(i), float(i % 3)) for i in range(6)], "walk_id long, zone long, item long, cx double, cy double")
    now = spark.createDataFrame([(1, i, i + 4.0, i % 3 - 2.0) for i in range(6)], "walk_id long, item long, ix double, iy double")
    got = counting.moved_zones(then, now, ["walk_id", "zone"])
    assert np.allclose(got.first().h, [1, 0, 4, 0, 1, -2, 0, 0, 1])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in plan.splitlines() if "Join" in x]) == 1
