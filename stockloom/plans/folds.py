"""Queries on folds and streams. Where a fold has no SQL, tests hold it to hand-made walks, brute force and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions import geometry as g
from stockloom.functions import polygons
from stockloom.operators import commits as committed
from stockloom.operators import counting, folds, motion, registration
from stockloom.operators.detections import near_items
from stockloom.operators.graph import connected_components, contracted
from stockloom.plans import scenes
from stockloom.plans.detections import HEIGHT, WIDTH, _links
from stockloom.plans.durable import fresh_path, staged
from stockloom.sources.adapters import COMMITS, DETECTIONS, FRAMES, commits, detections, frames, with_sql
from stockloom.sources.tables import table
from stockloom.streaming import triggers, walks

TRIGGER = {"hold": 6.0, "limit": 60.0, "rearm": 15.0, "focal": 100.0, "width": 120.0, "height": 90.0}
FRAME_TIME = 1.0
SWEEP_SPEED = 200.0


def trigger_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a rolling median speed; the displacement's direction follows the frame's kind."""
    f = frames(spark, sf_dir)
    speed = F.when(F.col("lost"), F.lit(float("inf"))).otherwise(F.col("speed"))
    turned = F.when(F.col("kind") == "click", -F.col("px")).otherwise(F.col("px"))
    out = f.withColumn("speed", speed).withColumn("speed", motion.rolling_median("speed", 3))
    return out.select("walk_id", "frame", "t", "speed", (turned / 4).alias("dx"), (F.col("px") % 5).alias("dy"), "lost", F.col("px").alias("sharp"))


def _rounded(c: DataFrame) -> DataFrame:
    return c.withColumns({k: F.round(k, 6) for k in ("t", "hold_from", "t_key", "step_deg")})


_TURNED = f"degrees(atan(sqrt(ntx * ntx + nty * nty) / {TRIGGER['focal']}))"
_TRIGGERED = FRAMES + f""",
tf AS (SELECT *, coalesce(pace < {TRIGGER['limit']}, false) AS steady, coalesce(pace < {SWEEP_SPEED}, false) AS slow FROM (
  SELECT walk_id, frame, t, lost, px AS sharp, CASE WHEN kind = 'click' THEN -px ELSE px END / 4 AS dx, px % 5 AS dy,
    median(CASE WHEN lost THEN 'infinity'::DOUBLE ELSE speed END) OVER (PARTITION BY walk_id ORDER BY frame ROWS 2 PRECEDING) AS pace FROM frames)),
nx AS (SELECT walk_id AS w, frame AS f, t AS ft, lost AS fl, sharp AS fs, dx AS fx, dy AS fy, steady AS st, slow AS sl FROM tf)"""
# A row for each frame: the state after it, and what it fired. The keyframe is found afterwards, by a join on the frames of the hold.
HOLD_TRIGGER = "WITH RECURSIVE " + _TRIGGERED + f""",
walked AS (SELECT walk_id, frame, t, steady, true AS armed, CASE WHEN steady THEN t END AS since, CASE WHEN steady THEN frame END AS first, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty, false AS astray, 0::BIGINT AS n, false AS fired, NULL::DOUBLE AS step
    FROM tf WHERE frame = 1
  UNION ALL SELECT w, f, ft, st, now AND NOT fire, s1, f1, CASE WHEN fire THEN 0.0 ELSE ntx END, CASE WHEN fire THEN 0.0 ELSE nty END, off AND NOT fire, n + CASE WHEN fire THEN 1 ELSE 0 END, fire, CASE WHEN NOT off AND n > 0 THEN {_TURNED} END
    FROM (SELECT *, coalesce(st AND now AND ft - s1 >= {TRIGGER['hold']} - 1e-6, false) AS fire
      FROM (SELECT *, armed OR again AS now, CASE WHEN NOT st THEN NULL WHEN again OR since IS NULL THEN ft ELSE since END AS s1, CASE WHEN NOT st THEN NULL WHEN again OR since IS NULL THEN f ELSE first END AS f1
        FROM (SELECT *, NOT armed AND (fl OR {_TURNED} >= {TRIGGER['rearm']}) AS again
          FROM (SELECT *, tx + CASE WHEN fl THEN 0 ELSE fx END AS ntx, ty + CASE WHEN fl THEN 0 ELSE fy END AS nty, astray OR fl AS off FROM walked JOIN nx ON w = walk_id AND f = frame + 1)))))
SELECT c.walk_id, n, round(c.t, 6) AS t, round(since, 6) AS hold_from, arg_max(k.frame, (k.sharp, -k.frame)) AS frame, round(arg_max(k.t, (k.sharp, -k.frame)), 6) AS t_key, round(step, 6) AS step_deg, false AS no_hold
FROM walked c JOIN tf k ON k.walk_id = c.walk_id AND k.frame BETWEEN c.first AND c.frame AND k.t >= c.t - {TRIGGER['hold']} WHERE fired GROUP BY c.walk_id, n, c.t, since, step"""
TIMED_TRIGGER = "WITH RECURSIVE " + _TRIGGERED + f""",
walked AS (SELECT walk_id, frame, t, t - {FRAME_TIME} AS opened, 1::BIGINT AS since, NULL::DOUBLE AS from_, NULL::BIGINT AS first, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty, false AS astray, 0::BIGINT AS n, false AS fired, NULL::DOUBLE AS step FROM tf WHERE frame = 1
  UNION ALL SELECT w, f, ft, CASE WHEN fire THEN ft ELSE opened END, CASE WHEN fire THEN f + 1 ELSE since END, opened, since, CASE WHEN fire THEN 0.0 ELSE ntx END, CASE WHEN fire THEN 0.0 ELSE nty END, off AND NOT fire,
      n + CASE WHEN fire THEN 1 ELSE 0 END, fire, CASE WHEN NOT off AND n > 0 THEN {_TURNED} END
    FROM (SELECT *, ft - opened >= 48.0 - 1e-6 AS fire, tx + CASE WHEN fl THEN 0 ELSE fx END AS ntx, ty + CASE WHEN fl THEN 0 ELSE fy END AS nty, astray OR fl AS off FROM walked JOIN nx ON w = walk_id AND f = frame + 1))
SELECT c.walk_id, n, round(c.t, 6) AS t, round(from_, 6) AS hold_from, arg_max(k.frame, (k.sharp, -k.frame)) AS frame, round(arg_max(k.t, (k.sharp, -k.frame)), 6) AS t_key, round(step, 6) AS step_deg, false AS no_hold
FROM walked c JOIN tf k ON k.walk_id = c.walk_id AND k.frame BETWEEN c.first AND c.frame WHERE fired GROUP BY c.walk_id, n, c.t, from_, step"""

# The same walk over the view's advance: the sharpest frame so far past the mark is part of the state, and the next advance counts from it.
_AHEAD = f"1 - greatest(0.0::DOUBLE, 1 - abs(nsx) / {TRIGGER['width']}::DOUBLE) * greatest(0.0::DOUBLE, 1 - abs(nsy) / {TRIGGER['height']}::DOUBLE)"
_MOVED = """SELECT *, tx + CASE WHEN fl THEN 0 ELSE fx END AS ntx, ty + CASE WHEN fl THEN 0 ELSE fy END AS nty,
  sx + CASE WHEN fl THEN 0 ELSE fx END AS nsx, sy + CASE WHEN fl THEN 0 ELSE fy END AS nsy, astray OR fl AS off FROM walked JOIN nx ON w = walk_id AND f = frame + 1"""
_BEST = "CASE WHEN take THEN fs ELSE bs END AS b2s, CASE WHEN take THEN f ELSE bf END AS b2f, CASE WHEN take THEN ft ELSE bt END AS b2t, CASE WHEN take THEN nsx ELSE bx END AS b2x, CASE WHEN take THEN nsy ELSE b_y END AS b2y"
_NO_BEST = "CASE WHEN fire THEN NULL ELSE b2s END, CASE WHEN fire THEN NULL ELSE b2f END, CASE WHEN fire THEN NULL ELSE b2t END, CASE WHEN fire THEN NULL ELSE b2x END, CASE WHEN fire THEN NULL ELSE b2y END"
_START = "0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy"
SWEEP_TRIGGER = "WITH RECURSIVE " + _TRIGGERED + f""",
walked AS (SELECT walk_id, frame, t, t - {FRAME_TIME} AS opened, {_START}, CASE WHEN slow THEN sharp END AS bs, CASE WHEN slow THEN frame END AS bf, CASE WHEN slow THEN t END AS bt, CASE WHEN slow THEN 0.0::DOUBLE END AS bx, CASE WHEN slow THEN 0.0::DOUBLE END AS b_y,
      false AS astray, 0::BIGINT AS n, false AS fired, NULL::DOUBLE AS from_, NULL::BIGINT AS kf, NULL::DOUBLE AS kt, NULL::DOUBLE AS step FROM tf WHERE frame = 1
  UNION ALL SELECT w, f, ft, CASE WHEN fire THEN b2t ELSE opened END, CASE WHEN fire THEN 0.0 ELSE ntx END, CASE WHEN fire THEN 0.0 ELSE nty END, nsx - CASE WHEN fire THEN b2x ELSE 0 END, nsy - CASE WHEN fire THEN b2y ELSE 0 END, {_NO_BEST},
      off AND NOT fire, n + CASE WHEN fire THEN 1 ELSE 0 END, fire, opened, b2f, b2t, CASE WHEN NOT off AND n > 0 THEN {_TURNED} END
    FROM (SELECT *, ahead >= goal AND b2s IS NOT NULL AS fire FROM (SELECT *, {_BEST} FROM (SELECT *, ahead >= goal - 0.25::DOUBLE AND sl AND (bs IS NULL OR fs > bs) AS take
      FROM (SELECT *, {_AHEAD} AS ahead, CASE WHEN n > 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS goal FROM ({_MOVED}))))))
SELECT walk_id, n, round(t, 6) AS t, round(from_, 6) AS hold_from, kf AS frame, round(kt, 6) AS t_key, round(step, 6) AS step_deg, false AS no_hold FROM walked WHERE fired"""
FALLBACK_TRIGGER = "WITH RECURSIVE " + _TRIGGERED + f""",
walked AS (SELECT walk_id, frame, t, true AS armed, CASE WHEN steady THEN t END AS since, CASE WHEN steady THEN frame END AS first, {_START}, NULL::DOUBLE AS bs, NULL::BIGINT AS bf, NULL::DOUBLE AS bt, NULL::DOUBLE AS bx, NULL::DOUBLE AS b_y,
      false AS astray, 0::BIGINT AS n, false AS held, false AS swept, NULL::BIGINT AS kf, NULL::DOUBLE AS kt, NULL::DOUBLE AS step FROM tf WHERE frame = 1
  UNION ALL SELECT w, f, ft, now AND NOT hit, s1, f1, CASE WHEN fire THEN 0.0 ELSE ntx END, CASE WHEN fire THEN 0.0 ELSE nty END, CASE WHEN hit THEN 0.0 WHEN fire THEN nsx - b2x ELSE nsx END, CASE WHEN hit THEN 0.0 WHEN fire THEN nsy - b2y ELSE nsy END, {_NO_BEST},
      off AND NOT fire, n + CASE WHEN fire THEN 1 ELSE 0 END, hit, fire AND NOT hit, b2f, b2t, CASE WHEN NOT off AND n > 0 THEN {_TURNED} END
    FROM (SELECT *, hit OR ahead >= 0.7::DOUBLE AND b2s IS NOT NULL AND NOT st AS fire FROM (SELECT *, {_BEST} FROM (SELECT *, NOT hit AND ahead >= 0.7::DOUBLE - 0.35::DOUBLE AND sl AND (bs IS NULL OR fs > bs) AS take
      FROM (SELECT *, coalesce(st AND now AND ft - s1 >= {TRIGGER['hold']} - 1e-6, false) AS hit, {_AHEAD} AS ahead
        FROM (SELECT *, armed OR again AS now, CASE WHEN NOT st THEN NULL WHEN again OR since IS NULL THEN ft ELSE since END AS s1, CASE WHEN NOT st THEN NULL WHEN again OR since IS NULL THEN f ELSE first END AS f1
          FROM (SELECT *, NOT armed AND (fl OR {_TURNED} >= {TRIGGER['rearm']}) AS again FROM ({_MOVED})))))))),
keys AS (SELECT c.walk_id, n, c.t, since AS from_, arg_max(k.frame, (k.sharp, -k.frame)) AS frame, arg_max(k.t, (k.sharp, -k.frame)) AS kt, step, false AS no_hold
    FROM walked c JOIN tf k ON k.walk_id = c.walk_id AND k.frame BETWEEN c.first AND c.frame AND k.t >= c.t - {TRIGGER['hold']} WHERE held GROUP BY c.walk_id, n, c.t, since, step
  UNION ALL SELECT walk_id, n, t, kt, kf, kt, step, true FROM walked WHERE swept)
SELECT walk_id, n, round(t, 6) AS t, round(from_, 6) AS hold_from, frame, round(kt, 6) AS t_key, round(step, 6) AS step_deg, no_hold FROM keys"""


def hold_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(committed.trigger_commits(trigger_frames(spark, sf_dir), FRAME_TIME, **TRIGGER))


def timed_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(committed.trigger_commits(trigger_frames(spark, sf_dir), FRAME_TIME, every=48.0, **TRIGGER))


def sweep_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(committed.trigger_commits(trigger_frames(spark, sf_dir), FRAME_TIME, sweep=0.5, sweep_speed=SWEEP_SPEED, **TRIGGER))


def fallback_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(committed.trigger_commits(trigger_frames(spark, sf_dir), FRAME_TIME, fallback=0.7, sweep_speed=SWEEP_SPEED, **TRIGGER))


OVER = 0.3


def consistent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed links of each commit without look-alikes (J12): of two candidates whose views share over 0.3 of this view, but which are not
    proposed with each other, the weaker goes. Views are warped to this one and cut with each other; all by commit."""
    c = commits(spark, sf_dir)
    key = lambda n: c.select("walk_id", F.col("n").alias(n), F.col("commit_id").alias(f"k{n}"))
    lk = scenes.proposed_pairs(spark, sf_dir).join(key("a"), ["walk_id", "a"]).join(key("b"), ["walk_id", "b"])
    lk = staged(lk.select("walk_id", "a", "b", "ka", "kb", (40 + (F.col("ka") * 7 + F.col("kb") * 13) % 60).alias("inliers")), "proposed")
    other = lk.select("walk_id", "b", F.col("a").alias("c"), F.col("ka").alias("kc"))
    linked = lk.select("walk_id", "a", F.col("b").alias("c"))
    met = lk.join(other, ["walk_id", "b"]).where("a < c").join(linked, ["walk_id", "a", "c"], "left_anti")
    quad = lambda k: scenes._warped(scenes.view_transform(F.col(k), F.col("kb")))
    view = [(F.lit(x), F.lit(y)) for x, y in scenes._CORNERS(0.0)]
    shared = polygons.shared_area(quad("ka"), quad("kc"), view)
    clash = met.where(shared > OVER * WIDTH * HEIGHT).select("walk_id", "b", F.explode(F.array(F.struct("a", F.col("c").alias("foe")), F.struct(F.col("c").alias("a"), F.col("a").alias("foe")))).alias("p"))
    foes = clash.groupBy("walk_id", "b", F.col("p.a").alias("a")).agg(F.collect_set("p.foe").alias("foes"))
    rows = lk.join(foes, ["walk_id", "b", "a"], "left").select("walk_id", F.col("b").alias("commit_n"), "a", "inliers", F.coalesce("foes", F.array().cast("array<bigint>")).alias("foes"))
    return registration.consistent_links(rows)


_QUAD = lambda k: scenes._polygon_sql(scenes._warped_sql(k, "kb"))
CONSISTENT_LINKS = "WITH RECURSIVE " + ", ".join([
    COMMITS, scenes.WORDS, "lk AS (SELECT p.walk_id, p.a, p.b, x.commit_id AS ka, y.commit_id AS kb, 40 + (x.commit_id * 7 + y.commit_id * 13) % 60 AS inliers FROM (" + scenes.PAIRS + ") p JOIN commits x ON x.walk_id = p.walk_id AND x.n = p.a JOIN commits y ON y.walk_id = p.walk_id AND y.n = p.b)",
    f"met AS (SELECT x.walk_id, x.b, x.a, y.a AS c, {_QUAD('x.ka').replace('(kb', '(x.kb')} AS one, {_QUAD('y.ka').replace('(kb', '(x.kb')} AS two, {scenes._VIEW} AS view_ FROM lk x JOIN lk y ON x.walk_id = y.walk_id AND x.b = y.b AND x.a < y.a WHERE NOT EXISTS (SELECT 1 FROM lk z WHERE z.walk_id = x.walk_id AND z.a = x.a AND z.b = y.a))",
    *scenes._clip_steps("met", "one", "two", "cut"), *scenes._clip_steps("cut4", "cut_p4", "view_", "seen"),
    f"clash AS (SELECT walk_id, b, a, c FROM seen4 WHERE {scenes._area_sql('seen_p4')} > {OVER * WIDTH * HEIGHT}::DOUBLE)",
    """foes AS (SELECT walk_id, b, a, list(c) AS foes FROM (SELECT walk_id, b, a, c FROM clash UNION ALL SELECT walk_id, b, c, a FROM clash) GROUP BY ALL),
ordered AS (SELECT l.walk_id, l.b AS commit_n, l.a, l.inliers, coalesce(f.foes, []) AS foes, row_number() OVER (PARTITION BY l.walk_id, l.b ORDER BY l.inliers DESC, l.a) AS rank FROM lk l LEFT JOIN foes f ON f.walk_id = l.walk_id AND f.b = l.b AND f.a = l.a),
step AS (SELECT walk_id, commit_n, rank, [a] AS kept FROM ordered WHERE rank = 1
  UNION ALL SELECT o.walk_id, o.commit_n, o.rank, CASE WHEN list_has_any(s.kept, o.foes) THEN s.kept ELSE list_append(s.kept, o.a) END
  FROM step s JOIN ordered o ON o.walk_id = s.walk_id AND o.commit_n = s.commit_n AND o.rank = s.rank + 1)
SELECT walk_id, commit_n, a, inliers FROM ordered JOIN (SELECT walk_id, commit_n, arg_max(kept, rank) AS kept FROM step GROUP BY walk_id, commit_n) USING (walk_id, commit_n) WHERE list_contains(kept, a)""",
])


def _walk_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = commits(spark, sf_dir)
    dets = detections(spark, sf_dir).join(c.select("commit_id", "n", "t"), "commit_id")
    shift = lambda k: (F.col(k) % 5).cast("double")
    h = F.array(F.lit(1.0), F.lit(0.0), shift("kb") - shift("ka"), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return dets, _links(spark, sf_dir).select("walk_id", "a", "b", h.alias("h"), "inliers")


def counted_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones, matching and prompts with keyframe links (S5 in the image plane)."""
    return counting.count_commits(*_walk_inputs(spark, sf_dir), 0.92, 130.0, 100.0, 1.0, 12.0)


def tracked_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with items carried from commit to commit and dead reckoning of 30 days."""
    return counting.count_commits(*_walk_inputs(spark, sf_dir), 0.92, 130.0, 100.0, 1.0, 12.0, motion=True, dead_reckon=30.0)


def streamed_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of ``counted_walks`` from a stream of commits over slices of time, taken up again from its checkpoint for each."""
    base = fresh_path(spark, "commits")
    dets, links = _walk_inputs(spark, sf_dir)
    timed = dets.withColumn("ts", F.timestamp_seconds(F.round(F.col("t") * 86_400).cast("long")))
    rows = walks.commit_rows(timed, links, 0.92, 130.0, 100.0, 1.0, 12.0)
    for _ in _slices(rows, "ts", f"{base}/in", 3):
        src = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        q = walks.stream_statuses(src, 130.0, 100.0, 12.0, expire="3650 days").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(counting.STATUS_SCHEMA).parquet(f"{base}/out")


GATE = 20.0


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of each walk and class between the sides of its lines, gated (J4): matches, cost, rest.

    Pairs within the gate meet on grid cells; each connected group of such pairs is assigned on its own, which is exact, since
    no pair beyond the gate may match.
    """
    cx, cy = g.centre(g.box())
    key = F.xxhash64("commit_id", "det_id")
    d = staged(detections(spark, sf_dir).select("walk_id", "cls", "side", key.alias("k"), cx.alias("cx"), cy.alias("cy")), "points")
    items = d.where("side = 'F'").select("walk_id", "cls", F.col("k").alias("item"), F.col("cx").alias("ix"), F.col("cy").alias("iy"))
    pairs = near_items(d.where("side = 'O'"), items, ["walk_id", "cls"], "cx", "cy", GATE).withColumn("dist", F.hypot(F.col("cx") - F.col("ix"), F.col("cy") - F.col("iy")))
    pairs = staged(pairs.where(F.col("dist") <= GATE).select("walk_id", "cls", F.col("k").alias("det"), "item", "dist"), "gated")
    groups = connected_components(contracted(pairs, "det", "item", ["walk_id", "cls"]))
    got = folds.assigned_groups(pairs.join(groups.select(F.col("node").alias("det"), F.col("component").alias("grp")), "det").select("walk_id", "grp", "det", "item", "dist"))
    of = got.groupBy("walk_id").agg(F.sum("matches").alias("matches"), F.sum("cost").alias("cost"))
    whole = d.groupBy("walk_id").agg(F.count_if(F.col("side") == "O").alias("dets"))
    matches = F.coalesce("matches", F.lit(0)).cast("long")
    return whole.join(of, "walk_id", "left").select("walk_id", matches.alias("matches"), F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("cost"), (F.col("dets") - matches).alias("left_over"))


STRATEGIES = {"near": 6.0, "wide": 12.0}
DRIFTS = (0.0, 2.0, 5.0, 8.0)


def strategy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted and missed detections of one side for each gate and drift: the drift moves a detection before it is gated."""
    all_ = staged(detections(spark, sf_dir).where("side in ('O', 'F')").groupBy("walk_id", "cls", "side", *g.box()).agg(F.count("*").alias("many")), "places")
    own = all_.where("side = 'O'")
    grid = [(name, gate, drift) for name, gate in STRATEGIES.items() for drift in DRIFTS]
    cx, cy = g.centre(g.box())
    # Places within the widest gate of any drift meet once, and stand for all their detections; a row says which gates and drifts cover a place.
    points = own.select("*", (cx + max(DRIFTS) / 2).alias("_x"), (cy * 0.5).alias("_y"))
    items = all_.where("side = 'F'").select("walk_id", "cls", cx.alias("ix"), (cy * 0.5).alias("iy"), cy.alias("_cy"))
    pairs = near_items(points, items, ["walk_id", "cls"], "_x", "_y", max(STRATEGIES.values()) + (max(DRIFTS) - min(DRIFTS)) / 2)
    moved = lambda drift: (F.col("x0") + drift + (F.col("x1") + drift)) / 2
    covered = [(moved(drift) - F.col("ix")) ** 2 + ((cy - F.col("_cy")) * 0.5) ** 2 <= gate * gate for _, gate, drift in grid]
    hits = pairs.groupBy("walk_id", "cls", *g.box(), "many").agg(*(F.max(c).alias(f"_{i}") for i, c in enumerate(covered)))
    seen = hits.agg(*(F.coalesce(F.sum(F.when(F.col(f"_{i}"), F.col("many"))), F.lit(0)).alias(f"_{i}") for i in range(len(grid))))  # one row, as the next
    total = own.agg(F.sum("many").alias("detections"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("strategy"), F.lit(drift).alias("drift"), F.col(f"_{i}").alias("seen")) for i, (name, _, drift) in enumerate(grid))))
    out = seen.crossJoin(total).select("detections", each.alias("s")).select("s.strategy", "s.drift", (F.col("detections") - F.col("s.seen")).alias("counted"), "detections")
    return out.where("counted > 0").select("strategy", "drift", "counted", "detections", F.round(100.0 * (F.col("detections") - F.col("counted")) / F.col("detections"), 6).alias("seen_percent"))


STRATEGY_GRID = with_sql(DETECTIONS) + f"""
SELECT strategy, drift, count(*) AS counted, any_value(detections) AS detections, round(100.0::DOUBLE * (any_value(detections) - count(*)) / any_value(detections), 6) AS seen_percent
FROM (SELECT * FROM detections WHERE side = 'O') a, (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in STRATEGIES.items())}) s(strategy, gate), (VALUES {', '.join(f'({v}::DOUBLE)' for v in DRIFTS)}) g(drift), (SELECT count(*) AS detections FROM detections WHERE side = 'O')
WHERE NOT EXISTS (SELECT 1 FROM detections b WHERE b.side = 'F' AND a.walk_id = b.walk_id AND a.cls = b.cls AND ((a.x0 + drift + a.x1 + drift) / 2 - (b.x0 + b.x1) / 2) ** 2 + (((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) * 0.5) ** 2 <= gate * gate) GROUP BY strategy, drift"""


def _slices(df: DataFrame, by: str, path: str, many: int):
    """Writes rows in slices of time, one after the other, each by all tasks; yields after each, so that a stream can take it in."""
    rows = staged(df, "feed")
    low, high = rows.agg(F.min(by), F.max(by)).first()
    step = (high - low) / many if low is not None else 0
    for i in range(many if low is not None else 1):
        part = rows.where((F.col(by) >= F.lit(low + i * step)) & ((F.col(by) < F.lit(low + (i + 1) * step)) | F.lit(i == many - 1))) if low is not None else rows
        part.write.mode("append").parquet(path)
        yield i


def streamed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hold trigger as a stream over slices of time, taken up again from its checkpoint for each: equal to the batch fold.

    The state of a walk without frames for 40 days is dropped.
    """
    base = fresh_path(spark, "frames")
    frames_of = trigger_frames(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("t") * 3600))
    for _ in _slices(frames_of, "t", f"{base}/in", 3):
        got = triggers.stream_commits(spark.readStream.schema(frames_of.schema).parquet(f"{base}/in"), FRAME_TIME, expire="40 days", **TRIGGER)
        q = got.writeStream.foreachBatch(triggers.exactly_once(f"{base}/out", ["walk_id", "n"])).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return _rounded(spark.read.schema(committed.COMMIT_SCHEMA + ", batch long").parquet(f"{base}/out").drop("batch"))


STREAMED_COMMITS = HOLD_TRIGGER


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by kind as a stream in append mode: only windows that the watermark has closed are there."""
    base = fresh_path(spark, "windows")
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("kind"), "value")
    for _ in _slices(e, "ts", f"{base}/in", 4):
        src = spark.readStream.schema(e.schema).parquet(f"{base}/in")
        q = triggers.windowed_counts(src, "1 day").writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema("start timestamp, kind string, frames long, total double").parquet(f"{base}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


def batch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by kind, as the streamed query gives them once all windows are closed."""
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("kind"), "value")
    return triggers.windowed_counts(e, "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


BATCH_WINDOWS = "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS kind, count(*) AS frames, round(sum(value), 4) AS total FROM events GROUP BY ALL"
# Slices come in order of time, so no row is late; the watermark, an hour behind the last row, has closed all windows that end before it.
STREAMED_WINDOWS = f"SELECT * FROM ({BATCH_WINDOWS}) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = triggers.steady_sessions(table(spark, sf_dir, "events"), "6 hours", 60.0)
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "frames")


SESSION_WINDOWS = """
SELECT user_id, min(ts) AS start, count(*) AS frames FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE value < 60)) GROUP BY user_id, s"""


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("kind"), "value")
    return triggers.windowed_counts(e, "2 days", "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


SLIDING_WINDOWS = """
SELECT (date_trunc('day', ts) - INTERVAL 1 DAY * k)::TIMESTAMP AS start, event_type AS kind, count(*) AS frames, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL"""

_NAMES = "hold_trigger timed_trigger sweep_trigger fallback_trigger consistent_links counted_walks tracked_walks assigned strategy_grid streamed_commits streamed_windows batch_windows session_windows sliding_windows".split()
QUERIES = {f"q{i + 67}_{n}": globals()[n] for i, n in enumerate(_NAMES)} | {"q109_streamed_statuses": streamed_statuses}
ORACLE_SQL = {f"q{i + 67}_{n}": globals()[n.upper()] for i, n in enumerate(_NAMES) if n.upper() in globals()}
