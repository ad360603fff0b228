"""Queries on motion frames and commits, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.functions.geometry import view_advance
from stockloom.operators import motion
from stockloom.sources.adapters import COMMITS, FRAMES, commits, frames, with_sql

LIMIT, FOCAL = 35.0, 50.0


def frame_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = motion.steps(frames(spark, sf_dir), FOCAL, 0.5)
    out = f.where("deg_s < double('infinity')").withColumn("advance", view_advance(F.col("px"), F.col("px") / 2, F.lit(100.0), F.lit(80.0)))
    return out.select("walk_id", "frame", F.round("dt", 6).alias("dt"), F.round("angle", 6).alias("angle"), F.round("deg_s", 4).alias("deg_s"), F.round("advance", 8).alias("advance"))


FRAME_SPEED = with_sql(FRAMES) + f"""
SELECT walk_id, frame, round(dt, 6) AS dt, round(angle, 6) AS angle, round(angle / dt, 4) AS deg_s,
  round(1 - greatest(0, 1 - px / 100.0) * greatest(0, 1 - px / 2 / 80.0), 8) AS advance
FROM (SELECT *, CASE WHEN t - before > 0 THEN t - before ELSE 0.5 END AS dt, degrees(atan(px / {FOCAL})) AS angle
  FROM (SELECT *, lag(t) OVER (PARTITION BY walk_id ORDER BY frame) AS before FROM frames)) WHERE before IS NOT NULL AND NOT lost"""


def steady_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = motion.holds(frames(spark, sf_dir), LIMIT)
    return h.select("walk_id", "hold", F.round("t_from", 6).alias("t_from"), F.round("t_to", 6).alias("t_to"), "frames")


HOLDS = f"""holds AS (
  SELECT walk_id, CAST(row_number() OVER (PARTITION BY walk_id ORDER BY min(t)) AS BIGINT) AS hold, min(t) AS t_from, max(t) AS t_to, count(*) AS frames
  FROM (SELECT *, sum(turn) OVER (PARTITION BY walk_id ORDER BY frame) AS run
    FROM (SELECT *, CASE WHEN steady IS DISTINCT FROM lag(steady) OVER (PARTITION BY walk_id ORDER BY frame) THEN 1 ELSE 0 END AS turn
      FROM (SELECT *, median(speed) OVER (PARTITION BY walk_id ORDER BY frame ROWS 2 PRECEDING) < {LIMIT} AS steady FROM frames)))
  WHERE steady GROUP BY walk_id, run)"""
STEADY_HOLDS = with_sql(FRAMES, HOLDS) + "SELECT walk_id, hold, round(t_from, 6) AS t_from, round(t_to, 6) AS t_to, frames FROM holds"


def hold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    h = motion.holds(f, LIMIT).groupBy("walk_id").agg(F.sum(F.col("t_to") - F.col("t_from")).alias("steady"), F.count_if(F.col("t_to") - F.col("t_from") >= 8).alias("long_holds"))
    whole = f.groupBy("walk_id").agg((F.max("t") - F.min("t")).alias("length"))
    return whole.join(h, "walk_id", "left").select("walk_id", F.round(F.coalesce("steady", F.lit(0.0)), 4).alias("steady"), F.round(100 * F.coalesce("steady", F.lit(0.0)) / F.greatest("length", F.lit(1e-9)), 4).alias("steady_percent"), F.coalesce("long_holds", F.lit(0)).cast("long").alias("long_holds"))


HOLD_SUMMARY = with_sql(FRAMES, HOLDS) + """
SELECT walk_id, round(coalesce(steady, 0), 4) AS steady, round(100 * coalesce(steady, 0) / greatest(length, 1e-9), 4) AS steady_percent, CAST(coalesce(long_holds, 0) AS BIGINT) AS long_holds
FROM (SELECT walk_id, max(t) - min(t) AS length FROM frames GROUP BY walk_id)
LEFT JOIN (SELECT walk_id, sum(t_to - t_from) AS steady, count(*) FILTER (WHERE t_to - t_from >= 8) AS long_holds FROM holds GROUP BY walk_id) USING (walk_id)"""


def hold_trigger_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.simple_trigger(frames(spark, sf_dir), LIMIT, 8.0).select("walk_id", "frame", F.round("t", 6).alias("t"), F.round("hold_from", 6).alias("hold_from"))


HOLD_TRIGGER_WINDOWS = with_sql(FRAMES) + f"""
SELECT walk_id, min(frame) AS frame, round(min(t), 6) AS t, round(min(since), 6) AS hold_from
FROM (SELECT *, min(t) OVER (PARTITION BY walk_id, run) AS since
  FROM (SELECT *, sum(turn) OVER (PARTITION BY walk_id ORDER BY frame) AS run
    FROM (SELECT *, CASE WHEN steady IS DISTINCT FROM lag(steady) OVER (PARTITION BY walk_id ORDER BY frame) THEN 1 ELSE 0 END AS turn
      FROM (SELECT *, median(speed) OVER (PARTITION BY walk_id ORDER BY frame ROWS 2 PRECEDING) < {LIMIT} AS steady FROM frames))) WHERE steady)
WHERE t - since >= 8 - 1e-6 GROUP BY walk_id, run"""


def key_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.sharpest_in_window(frames(spark, sf_dir), 24.0, "px").select("walk_id", "frame", "key_frame")


KEY_FRAMES = with_sql(FRAMES) + """
SELECT a.walk_id, a.frame, arg_max(b.frame, (b.px, -b.frame)) AS key_frame
FROM frames a JOIN frames b ON a.walk_id = b.walk_id AND b.t >= a.t - 24.0 AND b.t <= a.t GROUP BY a.walk_id, a.frame"""


def commit_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps with the ends of the recording, which is that of all walks."""
    c = commits(spark, sf_dir)
    ends = c.agg(F.min("t").alias("opened"), F.max("t").alias("closed"))  # one row
    g = motion.gap_summary(c.crossJoin(ends), F.col("opened"), F.col("closed"))
    return g.select("walk_id", F.round("max_gap", 6).alias("max_gap"), F.round("median_gap", 6).alias("median_gap"), "commits", F.round(F.col("commits") / F.greatest("length", F.lit(1.0)), 6).alias("commits_a_day"))


COMMIT_GAPS = with_sql(COMMITS) + """
SELECT m.walk_id, max_gap, median_gap, commits, round(commits / greatest((SELECT max(t) - min(t) FROM commits), 1.0), 6) AS commits_a_day
FROM (SELECT walk_id, round(max(moment - before), 6) AS max_gap FROM (SELECT walk_id, moment, lag(moment) OVER (PARTITION BY walk_id ORDER BY moment, k) AS before
  FROM (SELECT walk_id, t AS moment, n AS k FROM commits UNION ALL SELECT DISTINCT walk_id, (SELECT min(t) FROM commits), 0 FROM commits UNION ALL SELECT DISTINCT walk_id, (SELECT max(t) FROM commits), 1000000000 FROM commits)) GROUP BY walk_id) m
JOIN (SELECT walk_id, count(*) AS commits, round(median(gap), 6) AS median_gap FROM (SELECT *, t - lag(t) OVER (PARTITION BY walk_id ORDER BY n) AS gap FROM commits) GROUP BY walk_id) i ON m.walk_id = i.walk_id"""


def step_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).where("not lost and frame > 1")
    p = f.groupBy("walk_id").agg(F.percentile("px", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    return p.select("walk_id", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


STEP_PERCENTILES = with_sql(FRAMES) + """
SELECT walk_id, round(quantile_cont(px, 0.1), 6) AS p10, round(quantile_cont(px, 0.5), 6) AS p50, round(quantile_cont(px, 0.9), 6) AS p90
FROM frames WHERE NOT lost AND frame > 1 GROUP BY walk_id"""


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return motion.flags(f.select("walk_id", "frame", F.col("speed").alias("luma"), F.col("px").alias("sharp"), (F.col("px") / 2000).alias("clipped")))


def frame_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("walk_id", "frame", F.array_join("flags", ",").alias("flags"))


_FLAGS = """flagged AS (SELECT walk_id, frame, concat_ws(',', CASE WHEN speed < 50 THEN 'dark' END, CASE WHEN px < 0.35 * median(px) OVER (PARTITION BY walk_id) THEN 'blurry' END,
  CASE WHEN px / 2000 > 0.02 THEN 'glare' END) AS flags FROM frames)"""
FRAME_FLAGS = with_sql(FRAMES, _FLAGS) + "SELECT walk_id, frame, flags FROM flagged"


def flag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


FLAG_HISTOGRAM = with_sql(FRAMES, _FLAGS) + "SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM flagged WHERE flags <> '') GROUP BY flag"


def lost_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = motion.segments(frames(spark, sf_dir), F.col("kind") == "purchase")
    return f.groupBy("walk_id", "segment").agg(F.max(F.col("lost").cast("int")).alias("lost"), F.sum("px").alias("moved"), F.min("frame").alias("first_frame")).select("walk_id", "segment", "lost", "moved", "first_frame")


LOST_SEGMENTS = with_sql(FRAMES) + """
SELECT walk_id, segment, CAST(max(CAST(lost AS INT)) AS INT) AS lost, sum(px) AS moved, min(frame) AS first_frame
FROM (SELECT *, CAST(sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY walk_id ORDER BY frame) AS BIGINT) AS segment FROM frames) GROUP BY walk_id, segment"""


def running_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum that restarts after each reset, as the sum so far less the sum at the last reset."""
    f = motion.segments(frames(spark, sf_dir), F.col("kind") == "click")
    w = Window.partitionBy("walk_id", "segment").orderBy("frame")
    return f.select("walk_id", "frame", (F.sum("px").over(w) - F.first("px").over(w)).alias("shift"))


RUNNING_SHIFT = with_sql(FRAMES) + """
SELECT walk_id, frame, sum(px) OVER w - first_value(px) OVER w AS shift
FROM (SELECT *, sum(CASE WHEN kind = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY walk_id ORDER BY frame) AS segment FROM frames) WINDOW w AS (PARTITION BY walk_id, segment ORDER BY frame)"""


def stable_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("track", F.concat_ws("/", F.col("walk_id").cast("string"), "kind"))
    return motion.stable_candidates(f, "track", 60.0, 3).select("walk_id", "frame", "kind", F.col("hits").cast("long").alias("hits"))


STABLE_HITS = with_sql(FRAMES) + """
SELECT walk_id, frame, kind, hits FROM (SELECT *, count(*) OVER (PARTITION BY walk_id, kind ORDER BY t RANGE BETWEEN 60.0 PRECEDING AND CURRENT ROW) AS hits FROM frames) WHERE hits >= 3"""


def dead_reckoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = motion.dead_reckoned(frames(spark, sf_dir), F.col("kind") == "view", 30.0)
    return f.groupBy("walk_id").agg(F.count_if("carried").alias("carried"), F.count("*").alias("frames"))


DEAD_RECKONING = with_sql(FRAMES) + """
SELECT walk_id, count(*) FILTER (WHERE t - seen <= 30.0) AS carried, count(*) AS frames
FROM (SELECT *, max(CASE WHEN kind = 'view' THEN t END) OVER (PARTITION BY walk_id ORDER BY frame) AS seen FROM frames) GROUP BY walk_id"""


def random_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("noise", F.col("px") % 7 - 3)
    return f.select("walk_id", "frame", F.sum("noise").over(motion.by_frame()).alias("drift"))


RANDOM_WALK = with_sql(FRAMES) + "SELECT walk_id, frame, sum(px % 7 - 3) OVER (PARTITION BY walk_id ORDER BY frame) AS drift FROM frames"


def leaky_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("noise", F.col("px") % 7 - 3)
    return motion.leaky_walk(f, "walk_id", "frame", "noise", 0.85).select("walk_id", "steps", F.round("x", 6).alias("x"))


LEAKY_WALK = with_sql(FRAMES) + """
SELECT walk_id, count(*) AS steps, round(list_reduce(list_prepend(0.0, list(px % 7 - 3 ORDER BY frame)), lambda x, e: 0.85 * x + e), 6) AS x FROM frames GROUP BY walk_id"""


def hold_commit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hold with the frames of kind purchase that it explains: an interval join, exactly one hit is good."""
    f = frames(spark, sf_dir)
    h = motion.holds(f, LIMIT)
    c = f.where("kind = 'purchase'").select(F.col("walk_id").alias("w"), F.col("t").alias("ct"))
    hit = h.join(c, (F.col("walk_id") == F.col("w")) & (F.col("ct") >= F.col("t_from") - 0.25) & (F.col("ct") <= F.col("t_to")), "left")
    return hit.groupBy("walk_id", "hold").agg(F.count("ct").alias("hits"), F.round(F.min("ct") - F.min("t_from"), 6).alias("delay"))


HOLD_COMMIT_JOIN = with_sql(FRAMES, HOLDS) + """
SELECT h.walk_id, h.hold, count(c.t) AS hits, round(min(c.t) - min(t_from), 6) AS delay
FROM holds h LEFT JOIN (SELECT * FROM frames WHERE kind = 'purchase') c ON h.walk_id = c.walk_id AND c.t >= t_from - 0.25 AND c.t <= t_to GROUP BY ALL"""


def pause_without_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds during which nothing was committed: an anti join on an interval."""
    f = frames(spark, sf_dir)
    h = motion.holds(f, LIMIT)
    c = f.where("kind = 'purchase'").select(F.col("walk_id").alias("w"), F.col("t").alias("ct"))
    return h.join(c, (h.walk_id == c.w) & F.col("ct").between(h.t_from, h.t_to), "left_anti").select("walk_id", "hold", "frames")


PAUSE_WITHOUT_COMMITS = with_sql(FRAMES, HOLDS) + """
SELECT walk_id, hold, frames FROM holds h WHERE NOT EXISTS (SELECT 1 FROM frames c WHERE c.kind = 'purchase' AND c.walk_id = h.walk_id AND c.t BETWEEN h.t_from AND h.t_to)"""


QUERIES = {
    "q02_frame_speed": frame_speed, "q03_steady_holds": steady_holds, "q04_hold_summary": hold_summary, "q05_hold_trigger_windows": hold_trigger_windows, "q06_key_frames": key_frames,
    "q07_commit_gaps": commit_gaps, "q08_step_percentiles": step_percentiles, "q09_frame_flags": frame_flags, "q10_flag_histogram": flag_histogram, "q11_lost_segments": lost_segments,
    "q12_running_shift": running_shift, "q13_stable_hits": stable_hits, "q14_dead_reckoning": dead_reckoning, "q15_random_walk": random_walk, "q16_leaky_walk": leaky_walk,
    "q17_hold_commit_join": hold_commit_join, "q18_pause_without_commits": pause_without_commits,
}
ORACLE_SQL = {
    "q02_frame_speed": FRAME_SPEED, "q03_steady_holds": STEADY_HOLDS, "q04_hold_summary": HOLD_SUMMARY, "q05_hold_trigger_windows": HOLD_TRIGGER_WINDOWS, "q06_key_frames": KEY_FRAMES,
    "q07_commit_gaps": COMMIT_GAPS, "q08_step_percentiles": STEP_PERCENTILES, "q09_frame_flags": FRAME_FLAGS, "q10_flag_histogram": FLAG_HISTOGRAM, "q11_lost_segments": LOST_SEGMENTS,
    "q12_running_shift": RUNNING_SHIFT, "q13_stable_hits": STABLE_HITS, "q14_dead_reckoning": DEAD_RECKONING, "q15_random_walk": RANDOM_WALK, "q16_leaky_walk": LEAKY_WALK,
    "q17_hold_commit_join": HOLD_COMMIT_JOIN, "q18_pause_without_commits": PAUSE_WITHOUT_COMMITS,
}
