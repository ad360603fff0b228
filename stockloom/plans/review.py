"""Queries on walks under review: truth documents, detectors by name, comparisons, corrections, clips; each with its SQL for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.functions import geometry as g
from stockloom.operators import detectors, ledger, motion
from stockloom.operators.detections import box_hits, near_items
from stockloom.plans.detections import _IOU, _LINKS_SQL, _STATUS, _links, _statused
from stockloom.plans.durable import staged
from stockloom.plans.folds import FALLBACK_TRIGGER, HOLD_TRIGGER, SWEEP_TRIGGER, TIMED_TRIGGER, fallback_trigger, hold_trigger, sweep_trigger, timed_trigger
from stockloom.sources.adapters import COMMITS, DETECTIONS, FRAMES, commits, detections, frames, sku, with_sql
from stockloom.sources.tables import table


def truth_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of a truth document, one row each: id, class, product, whole-number box (K5)."""
    x, y = (F.col("code") % 97 * 20).cast("int"), (F.col("code") % 5 * 400).cast("int")
    box = (x, y, x + F.col("units_per_case").cast("int"), y + 300)
    return sku(spark, sf_dir).select(F.col("code").alias("id"), F.element_at(F.split("category", " "), -1).alias("cls"), F.concat(F.lit("sku-"), F.col("code").cast("string")).alias("sku"), *(v.alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))


TRUTH_OBJECTS = """SELECT p_partkey AS id, string_split(p_type, ' ')[-1] AS cls, 'sku-' || p_partkey AS sku, (p_partkey % 97 * 20)::INT AS x0, (p_partkey % 5 * 400)::INT AS y0,
  (p_partkey % 97 * 20 + p_size)::INT AS x1, (p_partkey % 5 * 400 + 300)::INT AS y1 FROM part"""


def truth_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform of each frame of a truth document: the view's move since the walk began (K5)."""
    f = frames(spark, sf_dir)
    so_far = lambda c: F.sum(c).over(motion.by_frame().rowsBetween(Window.unboundedPreceding, 0))
    return f.select("walk_id", "frame", F.lit(1.0).alias("m0"), F.lit(0.0).alias("m1"), (-so_far(F.col("px"))).alias("m2"), F.lit(0.0).alias("m3"), F.lit(1.0).alias("m4"), (-so_far(F.col("px") % 5)).alias("m5"))


TRUTH_FRAMES = with_sql(FRAMES) + """
SELECT walk_id, frame, 1.0::DOUBLE AS m0, 0.0::DOUBLE AS m1, -sum(px) OVER w AS m2, 0.0::DOUBLE AS m3, 1.0::DOUBLE AS m4, -sum(px % 5) OVER w AS m5
FROM frames WINDOW w AS (PARTITION BY walk_id ORDER BY frame)"""


def detector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown and counted boxes by detector and class, with zero rows; thresholds come from the registry by name (F2, P10)."""
    d = staged(detections(spark, sf_dir).select("cls", "x0", "y0", "x1", "y1", ((F.col("score") - 0.9) * 10).alias("score")), "boxes")
    out = reduce(DataFrame.unionByName, (detectors.detector(n)(d).select(F.lit(n).alias("detector"), "cls", "counted") for n in detectors.names()))
    got = out.groupBy("detector", "cls").agg(F.count("*").alias("shown"), F.count_if("counted").alias("counted"))
    every = d.select("cls").distinct().select(F.explode(F.array(*map(F.lit, detectors.names()))).alias("detector"), "cls")
    return every.join(got, ["detector", "cls"], "left").select("detector", "cls", F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("counted", F.lit(0)).alias("counted"))


_EDGE = "(least(abs(x0 - 64), abs(x1 - 64), abs(y0 - 48), abs(y1 - 48)) <= 2)"
DETECTOR_COUNTS = with_sql(DETECTIONS) + f"""
SELECT detector, cls, count(*) FILTER (WHERE ok AND s >= lo) AS shown, count(*) FILTER (WHERE ok AND s >= lo AND s >= hi) AS counted
FROM (SELECT cls, (score - 0.9) * 10 AS s, NOT {_EDGE} AS inside FROM detections), (VALUES {', '.join(f"('{n}', {lo}::DOUBLE, {hi}::DOUBLE, {str(tiled).lower()})" for n, (lo, hi, tiled) in detectors.THRESHOLDS.items())}) t(detector, lo, hi, tiled),
LATERAL (SELECT NOT tiled OR inside AS ok) GROUP BY detector, cls"""


def after_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and missed detections of each class after matching with the commits before, zero rows included (A1, A2).

    A detection is matched if an earlier commit of its walk has one of its class whose centre is within half its box.
    """
    d = _statused(spark, sf_dir).join(commits(spark, sf_dir).select("commit_id", "n"), "commit_id")
    cx, cy = g.centre(g.box())
    live = staged(d.where("status in ('inner', 'band')").withColumn("cx", cx).withColumn("cy", cy), "live")
    reach = live.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0
    old = live.select("walk_id", "cls", F.col("n").alias("m"), F.col("cx").alias("ix"), F.col("cy").alias("iy"))
    near = (F.col("m") < F.col("n")) & (F.abs(F.col("cx") - F.col("ix")) * 2 <= F.col("x1") - F.col("x0")) & (F.abs(F.col("cy") - F.col("iy")) * 2 <= F.col("y1") - F.col("y0"))
    seen = near_items(live, old, ["walk_id", "cls"], "cx", "cy", max(reach / 2, 1e-6)).where(near).select("commit_id", "det_id").distinct()
    marked = live.join(seen.withColumn("old", F.lit(True)), ["commit_id", "det_id"], "left").withColumn("old", F.coalesce("old", F.lit(False)))
    counts = marked.groupBy("cls").agg(F.count_if(~F.col("old") & (F.col("status") == "inner")).alias("new"), F.count_if(~F.col("old") & (F.col("status") == "band")).alias("edge"), F.count_if("old").alias("seen"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.select("cls").distinct().join(counts, "cls", "left").select("cls", zero("new"), zero("edge"), zero("seen"))


AFTER_MATCHING = with_sql(DETECTIONS, COMMITS, _STATUS, "live AS (SELECT s.*, c.n, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM statused s JOIN commits c USING (commit_id) WHERE s.status IN ('inner', 'band'))") + """
SELECT k.cls, coalesce(count(*) FILTER (WHERE NOT old AND status = 'inner'), 0) AS "new", coalesce(count(*) FILTER (WHERE NOT old AND status = 'band'), 0) AS edge, coalesce(count(*) FILTER (WHERE old), 0) AS seen
FROM (SELECT DISTINCT cls FROM detections) k LEFT JOIN (SELECT a.cls, a.status, EXISTS (SELECT 1 FROM live b WHERE b.walk_id = a.walk_id AND b.cls = a.cls AND b.n < a.n AND abs(a.cx - b.cx) * 2 <= a.x1 - a.x0 AND abs(a.cy - b.cy) * 2 <= a.y1 - a.y0) AS old
  FROM live a) l ON l.cls = k.cls GROUP BY k.cls"""


def prompt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products prompted for in a walk (seen in the band only), and the useful prompts: those never counted in it."""
    per = _statused(spark, sf_dir).groupBy("walk_id", "sku").agg(F.count_if(F.col("status") == "band").alias("band"), F.count_if(F.col("status") == "inner").alias("inner"))
    return per.where("band > 0").groupBy("walk_id").agg(F.count("*").alias("prompts"), F.count_if(F.col("inner") == 0).alias("useful"))


PROMPT_COUNTS = with_sql(DETECTIONS, _STATUS) + """
SELECT walk_id, count(*) AS prompts, count(*) FILTER (WHERE inside = 0) AS useful FROM (SELECT walk_id, sku, count(*) FILTER (WHERE status = 'band') AS band, count(*) FILTER (WHERE status = 'inner') AS inside FROM statused GROUP BY ALL) WHERE band > 0 GROUP BY walk_id"""


def overlap_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each commit the one before it, the features of either that lie in their overlap, and the smaller of the counts."""
    c = commits(spark, sf_dir).withColumn("before", F.lag("commit_id").over(Window.partitionBy("walk_id").orderBy("n"))).where("before is not null")
    cx = (F.col("x0") + F.col("x1")) / 2
    inside = detections(spark, sf_dir).groupBy("commit_id").agg(F.count_if(cx >= 40).alias("right"), F.count_if(cx <= 90).alias("left"))
    own = c.select("walk_id", "commit_id", "n", "before").join(inside.select("commit_id", F.col("right").alias("here")), "commit_id", "left")
    there = inside.select(F.col("commit_id").alias("before"), F.col("left").alias("there"))
    zero = lambda k: F.coalesce(k, F.lit(0))
    return own.join(there, "before", "left").select("walk_id", "n", zero("here").alias("here"), zero("there").alias("there"), F.least(zero("here"), zero("there")).alias("coverage"))


OVERLAP_COVERAGE = with_sql(DETECTIONS, COMMITS, "inside AS (SELECT commit_id, count(*) FILTER (WHERE (x0 + x1) / 2 >= 40) AS r, count(*) FILTER (WHERE (x0 + x1) / 2 <= 90) AS l FROM detections GROUP BY commit_id)") + """
SELECT a.walk_id, a.n, coalesce(i.r, 0) AS here, coalesce(j.l, 0) AS there, least(coalesce(i.r, 0), coalesce(j.l, 0)) AS coverage
FROM commits a JOIN commits b ON a.walk_id = b.walk_id AND b.n = a.n - 1 LEFT JOIN inside i ON i.commit_id = a.commit_id LEFT JOIN inside j ON j.commit_id = b.commit_id"""


def previous_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered overlap of each commit with the one before it, null where they do not register."""
    lk = _links(spark, sf_dir).where("b = a + 1").select("walk_id", F.col("b").alias("n"), "inliers")
    return commits(spark, sf_dir).select("walk_id", "n").join(lk, ["walk_id", "n"], "left")


PREVIOUS_LINKS = with_sql(COMMITS, _LINKS_SQL) + "SELECT c.walk_id, c.n, inliers FROM commits c LEFT JOIN links l ON l.walk_id = c.walk_id AND l.b = c.n AND l.a = c.n - 1"


def clipped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from a start time up to the walk's last commit, with the commit of a frame where it has one.

    Frames of kind purchase stand for commits.
    """
    f = frames(spark, sf_dir).where(F.col("t").between(24.0, 480.0))
    made = f.where("kind = 'purchase'").select("walk_id", "frame", F.row_number().over(motion.by_frame()).cast("long").alias("commit_n"))
    last = made.groupBy("walk_id").agg(F.max("frame").alias("last"))
    return f.join(last, "walk_id").where("frame <= last").join(made, ["walk_id", "frame"], "left").select("walk_id", "frame", "commit_n")


CLIPPED_FRAMES = with_sql(FRAMES, "f AS (SELECT * FROM frames WHERE t BETWEEN 24 AND 480), made AS (SELECT walk_id, frame, row_number() OVER (PARTITION BY walk_id ORDER BY frame) AS commit_n FROM f WHERE kind = 'purchase')") + """
SELECT f.walk_id, f.frame, commit_n FROM f LEFT JOIN made USING (walk_id, frame) WHERE f.frame <= (SELECT max(frame) FROM made m WHERE m.walk_id = f.walk_id)"""


def rack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits by the zone and rack that their tag stands for (J28): suppliers are tags, nations racks, regions zones."""
    tag = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tag"), F.col("s_nationkey").alias("rack"))
    rack = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rack"), F.col("n_name").alias("rack_name"), F.col("n_regionkey").alias("zone"))
    zone = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("zone"), F.col("r_name").alias("zone_name"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tag"), F.col("l_orderkey").alias("commit_id"))
    return seen.join(tag, "tag").join(rack, "rack").join(zone, "zone").groupBy("zone_name", "rack_name").agg(F.countDistinct("commit_id").alias("commits"))


RACK_LINES = """SELECT r_name AS zone_name, n_name AS rack_name, count(DISTINCT l_orderkey) AS commits FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL"""


def usable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds of the frames that are left once bad input is paused: tracking lost, and dark views."""
    ok = frames(spark, sf_dir).where("not lost and speed >= 5")
    return motion.holds(ok, 35.0).groupBy("walk_id").agg(F.count("*").alias("holds"), F.sum("frames").alias("frames"))


USABLE_FRAMES = with_sql(FRAMES) + """
SELECT walk_id, count(*) AS holds, CAST(sum(n) AS BIGINT) AS frames FROM (SELECT walk_id, run, count(*) AS n
  FROM (SELECT *, sum(turn) OVER (PARTITION BY walk_id ORDER BY frame) AS run
    FROM (SELECT *, CASE WHEN steady IS DISTINCT FROM lag(steady) OVER (PARTITION BY walk_id ORDER BY frame) THEN 1 ELSE 0 END AS turn
      FROM (SELECT *, median(speed) OVER (PARTITION BY walk_id ORDER BY frame ROWS 2 PRECEDING) < 35 AS steady FROM frames WHERE NOT lost AND speed >= 5))) WHERE steady GROUP BY walk_id, run) GROUP BY walk_id"""


def corrected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of each session's log after edits, deletions and undo (R12, X7): an undo takes back the last action that is left.

    Views are edits, errors undo, the rest counts. An undo pairs with the nearest action before it at its own depth.
    """
    e = frames(spark, sf_dir).withColumn("step", F.when(F.col("kind") == "error", -1).otherwise(1))
    so_far = motion.by_frame().rowsBetween(Window.unboundedPreceding, 0)
    depth = e.withColumn("sum", F.sum("step").over(so_far)).withColumn("depth", F.col("sum") - F.least(F.min("sum").over(so_far), F.lit(0)))  # an undo of nothing does nothing
    ahead = motion.by_frame().rowsBetween(1, Window.unboundedFollowing)
    kept = depth.withColumn("lowest", F.min("depth").over(ahead)).where("step = 1 and (lowest is null or lowest >= depth)")
    return kept.groupBy("walk_id").agg(F.count("*").alias("actions"), F.sum("px").alias("units"))


CORRECTED_GROUPS = "WITH RECURSIVE " + FRAMES + """,
nx AS (SELECT walk_id AS w, frame AS f, kind AS k, px AS p FROM frames),
walked AS (SELECT walk_id, frame, CASE WHEN kind = 'error' THEN [] ELSE [px] END AS held FROM frames WHERE frame = 1
  UNION ALL SELECT walk_id, frame + 1, CASE WHEN k = 'error' THEN held[:-2] ELSE list_append(held, p) END FROM walked JOIN nx ON w = walk_id AND f = frame + 1)
SELECT walk_id, len(held) AS actions, list_sum(held) AS units FROM (SELECT walk_id, arg_max(held, frame) AS held FROM walked GROUP BY walk_id) WHERE len(held) > 0"""


def busy_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that began while another of their device was open (X1): walks are sessions, seven devices."""
    s = frames(spark, sf_dir).groupBy(F.col("walk_id").alias("session")).agg(F.min("us").alias("start"), F.max("us").alias("stop")).withColumn("device", F.col("session") % 7)
    return ledger.overlapping_sessions(s, "device", "start", "stop").select("device", "session", "busy_until")


BUSY_DEVICES = with_sql(FRAMES, "s AS (SELECT walk_id AS session, walk_id % 7 AS device, min(us) AS start, max(us) AS stop FROM frames GROUP BY walk_id)") + """
SELECT a.device, a.session, max(b.stop) AS busy_until FROM s a JOIN s b ON a.device = b.device AND (b.start, b.session) < (a.start, a.session) GROUP BY a.device, a.session, a.start HAVING max(b.stop) > a.start"""


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion matrix of the nearest neighbour's label against the own one, for every 20th vector."""
    from stockloom.plans.detections import _knn

    names = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    top = _knn(spark, sf_dir, 1).join(names.select(F.col("vec_id").alias("q"), F.col("label").alias("truth")), "q").join(names.select(F.col("vec_id").alias("g"), F.col("label").alias("guess")), "g")
    return top.groupBy("truth", "guess").agg(F.count("*").alias("n"))


CONFUSION = """SELECT truth, e.label AS guess, count(*) AS n FROM (SELECT a.label AS truth, (SELECT b.vec_id FROM embeddings b WHERE b.vec_id <> a.vec_id
  ORDER BY round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) DESC, b.vec_id LIMIT 1) AS g FROM embeddings a WHERE a.vec_id % 20 = 0) JOIN embeddings e ON e.vec_id = g GROUP BY ALL"""


def trigger_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, walks with any, and steps of each trigger side by side (K6)."""
    runs = {"hold": hold_trigger, "timed": timed_trigger, "sweep": sweep_trigger, "fallback": fallback_trigger}
    rows = reduce(DataFrame.unionByName, (q(spark, sf_dir).select(F.lit(k).alias("trigger"), "walk_id", "step_deg", "no_hold") for k, q in runs.items()))
    return rows.groupBy("trigger").agg(F.count("*").alias("commits"), F.countDistinct("walk_id").alias("walks"), F.count("step_deg").alias("steps"), F.count_if("no_hold").alias("without_hold"))


_RUNS_SQL = {"hold": HOLD_TRIGGER, "timed": TIMED_TRIGGER, "sweep": SWEEP_TRIGGER, "fallback": FALLBACK_TRIGGER}
TRIGGER_COMPARISON = f"""SELECT "trigger", count(*) AS commits, count(DISTINCT walk_id) AS walks, count(step_deg) AS steps, count(*) FILTER (WHERE no_hold) AS without_hold
FROM ({" UNION ALL ".join(f"SELECT '{k}' AS " + f'"trigger", walk_id, step_deg, no_hold FROM ({v})' for k, v in _RUNS_SQL.items())}) GROUP BY "trigger" """


def mean_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of each class and the mean over classes (A25): lines of side O are shown, those of side F are the truth."""
    d = detections(spark, sf_dir).withColumn("score", F.round("score", 2))
    truth = d.where("side = 'F'")
    hits = box_hits(d.where("side = 'O'"), truth, 0.1)
    per = ledger.average_precision(hits, truth.groupBy("cls").agg(F.count("*").alias("positives")), "cls", "hit", "score")
    mean = F.avg("ap").over(Window.partitionBy(F.lit(0)))  # a row a class
    return per.select("cls", "shown", "hits", "positives", F.round("ap", 9).alias("ap"), F.round(mean, 9).alias("mean_ap"))


MEAN_PRECISION = with_sql(DETECTIONS, f"""d AS (SELECT * REPLACE (round(score, 2) AS score) FROM detections),
best AS (SELECT a.commit_id, a.det_id, a.score, b.det_id AS truth FROM d a JOIN d b ON a.commit_id = b.commit_id AND a.cls = b.cls AND a.side = 'O' AND b.side = 'F' WHERE round({_IOU}, 9) >= 0.1
  QUALIFY row_number() OVER (PARTITION BY a.commit_id, a.det_id ORDER BY round({_IOU}, 9) DESC, b.det_id) = 1),
found AS (SELECT commit_id, det_id FROM best QUALIFY row_number() OVER (PARTITION BY commit_id, truth ORDER BY score DESC, det_id) = 1),
scored AS (SELECT cls, score, count(f.det_id) AS p, count(*) AS n FROM d LEFT JOIN found f ON f.commit_id = d.commit_id AND f.det_id = d.det_id WHERE side = 'O' GROUP BY cls, score),
run AS (SELECT *, sum(p) OVER w / sum(n) OVER w AS precise FROM scored WINDOW w AS (PARTITION BY cls ORDER BY score DESC)),
per AS (SELECT cls, sum(n) AS shown, sum(p) AS hits, sum(p * best) AS area FROM (SELECT *, (SELECT max(precise) FROM run b WHERE b.cls = a.cls AND b.score <= a.score) AS best FROM run a) GROUP BY cls),
aps AS (SELECT t.cls, coalesce(shown, 0)::BIGINT AS shown, coalesce(hits, 0)::BIGINT AS hits, positives, coalesce(area / positives, 0) AS ap
  FROM (SELECT cls, count(*) AS positives FROM d WHERE side = 'F' GROUP BY cls) t LEFT JOIN per ON per.cls = t.cls)""") + """
SELECT cls, shown, hits, positives, round(ap, 9) AS ap, round((SELECT avg(ap) FROM aps), 9) AS mean_ap FROM aps"""


def pilot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares and percentiles of a pilot, a row each (A26, A30): recounted and exported sessions, their length, the wait for the first export,
    the lateral distance and the days between two sightings of a product."""
    kind = lambda k: F.count_if(F.col("kind") == k) > 0
    start = F.min("t")
    s = frames(spark, sf_dir).groupBy("walk_id").agg(kind("error").alias("redone"), kind("purchase").alias("sent"), F.round(F.max("t") - start, 3).alias("hours"), F.round(F.min(F.when(F.col("kind") == "purchase", F.col("t"))) - start, 3).alias("wait"))
    before = lambda c: F.lag(c).over(Window.partitionBy("walk_id", "sku").orderBy("at", "commit_id", "det_id"))
    cx, day = g.centre(g.box())[0], F.unix_micros(F.col("at").cast("timestamp")) / 8.64e10
    again = detections(spark, sf_dir).withColumn("cx", cx).withColumn("day", day).select(F.abs(F.col("cx") - before("cx")).alias("off"), F.round(F.col("day") - before("day"), 3).alias("days"))
    share = lambda c: F.avg(F.col(c).cast("double"))
    one = s.agg(share("redone").alias("recount share"), share("sent").alias("exported share"), *(F.percentile(c, p).alias(f"{c} p{int(p * 100)}") for c in ("hours", "wait") for p in (0.5, 0.95)))
    two = again.agg(*(F.percentile(c, p).alias(f"{c} p{int(p * 100)}") for c in ("off", "days") for p in (0.5, 0.95)))
    rows = lambda t: t.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.round(F.col(f"`{c}`"), 6).alias("value")) for c in t.columns))).alias("r")).select("r.*")
    return rows(one).unionByName(rows(two))


def _percentiles_sql(source: str, *names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c} p{int(p * 100)}', round(quantile_cont({c}, {p}), 6) FROM {source}" for c in names for p in (0.5, 0.95))


PILOT_METRICS = with_sql(FRAMES, DETECTIONS, """s AS (SELECT walk_id, bool_or(kind = 'error') AS redone, bool_or(kind = 'purchase') AS sent, round(max(t) - min(t), 3) AS hours,
  round(min(t) FILTER (WHERE kind = 'purchase') - min(t), 3) AS wait FROM frames GROUP BY walk_id)""", """again AS (SELECT abs((x0 + x1) / 2 - lag((x0 + x1) / 2) OVER w) AS off, round(epoch_us("at") / 8.64e10 - lag(epoch_us("at") / 8.64e10) OVER w, 3) AS days
  FROM detections WINDOW w AS (PARTITION BY walk_id, sku ORDER BY "at", commit_id, det_id))""") + f"""
SELECT 'recount share' AS metric, round(avg(redone::INT), 6) AS value FROM s UNION ALL SELECT 'exported share', round(avg(sent::INT), 6) FROM s
UNION ALL {_percentiles_sql("s", "hours", "wait")} UNION ALL {_percentiles_sql("again", "off", "days")}"""


def regrouped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and units of each group after people merged groups and split items off (X7, R12): suppliers are merges, products of one unit are split."""
    k = sku(spark, sf_dir)
    items = k.select(F.col("code").alias("item"), (F.col("code") % 400).alias("grp"))
    merges = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select((F.col("s_suppkey") % 400).alias("a"), ((F.col("s_suppkey") * 3 + 1) % 400).alias("b"))
    got = ledger.regrouped(items, merges, k.where("units_per_case = 1").select(F.col("code").alias("item")))
    return got.join(k.select(F.col("code").alias("item"), "units_per_case"), "item").groupBy("grp").agg(F.count("*").alias("items"), F.sum("units_per_case").alias("units"))


REGROUPED_ITEMS = "WITH RECURSIVE " + """pairs AS (SELECT s_suppkey % 400 AS a, (s_suppkey * 3 + 1) % 400 AS b FROM supplier WHERE s_suppkey % 4 = 0), ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
met AS (SELECT a AS grp, a AS seen FROM ways UNION SELECT m.grp, w.b FROM met m JOIN ways w ON w.a = m.seen), roots AS (SELECT grp, min(seen) AS root FROM met GROUP BY grp)
SELECT CASE WHEN p_size <> 1 THEN coalesce(root, p_partkey % 400) END AS grp, count(*) AS items, CAST(sum(p_size) AS BIGINT) AS units FROM part LEFT JOIN roots ON grp = p_partkey % 400 GROUP BY 1"""


def plausible_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose registration and whose zones' fit are plausible (P19, P20); their measures come from the keys."""
    lk = _links(spark, sf_dir)
    ka, kb = F.col("ka"), F.col("kb")
    registered = g.plausible_registration(F.col("inliers"), 100 + ka % 200, (ka + kb) % 5 != 0, ka % 60 / 10, kb % 20 / 100, kb % 30 / 100)
    fits = g.plausible_fit(0.5 + ka % 13 / 10, (kb % 9 - 4) / 10)
    return lk.select("walk_id", "a", "b", registered.alias("registered"), fits.alias("fits"))


PLAUSIBLE_LINKS = with_sql(COMMITS, _LINKS_SQL, "m AS (SELECT *, 0.5::DOUBLE + (ka % 13) / 10 AS fa, (kb % 9 - 4) / 10 AS fb FROM links)") + """
SELECT walk_id, a, b, inliers >= 40 AND inliers * 4 >= 100 + ka % 200 AND (ka + kb) % 5 <> 0 AND (ka % 60) / 10 > 0.2 AND (ka % 60) / 10 < 5 AND (kb % 20) / 100 >= 0.03 AND (kb % 30) / 100 >= 0.08 AS registered,
  sqrt(fa * fa + fb * fb) > 2 / 3 AND sqrt(fa * fa + fb * fb) < 1.5 AND abs(atan2(fb, fa)) < 0.26 AS fits FROM m"""


_NAMES = (
    "truth_objects truth_frames detector_counts after_matching prompt_counts overlap_coverage previous_links clipped_frames rack_lines usable_frames corrected_groups busy_devices confusion trigger_comparison "
    "mean_precision pilot_metrics regrouped_items plausible_links"
).split()
QUERIES = {f"q{i + 81}_{n}": globals()[n] for i, n in enumerate(_NAMES)}
ORACLE_SQL = {f"q{i + 81}_{n}": globals()[n.upper()] for i, n in enumerate(_NAMES) if n.upper() in globals()}
