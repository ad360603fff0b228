"""Queries on detections, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.functions import geometry as g
from stockloom.functions.text import percent_error
from stockloom.operators import detections as d
from stockloom.plans.durable import staged
from stockloom.sources.adapters import COMMITS, DETECTIONS, SKU, commits, detections, sku, with_sql
from stockloom.sources.tables import table

WIDTH, HEIGHT, MARGIN, BAND, THRESHOLD = 130.0, 100.0, 1.0, 12.0, 0.92

_STATUS = f"""statused AS (SELECT *, CASE WHEN score < {THRESHOLD} THEN 'low'
  WHEN x0 <= {MARGIN} OR y0 <= {MARGIN} OR x1 >= {WIDTH - MARGIN} OR y1 >= {HEIGHT - MARGIN} THEN 'cut'
  WHEN (x0 + x1) / 2 BETWEEN {BAND} AND {WIDTH - BAND} AND (y0 + y1) / 2 BETWEEN {BAND} AND {HEIGHT - BAND} THEN 'inner' ELSE 'band' END AS status FROM detections)"""


def _statused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).withColumn("status", d.status(F.col("score"), g.box(), THRESHOLD, WIDTH, HEIGHT, MARGIN, BAND))


def stock_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner detections counted per product and turned into export lines of cases and loose units."""
    inner = _statused(spark, sf_dir).where("status = 'inner'").groupBy(F.col("sku").alias("code")).agg(F.count("*").alias("total_units"), F.countDistinct("commit_id").alias("views"))
    line = inner.join(sku(spark, sf_dir), "code")
    upc = F.col("units_per_case")
    return line.select("code", "name", "brand", "category", "units_per_case", F.expr("total_units div units_per_case").alias("full_cases"), (F.col("total_units") % upc).alias("loose_units"), "total_units", "views")


STOCK_SHEET = with_sql(DETECTIONS, _STATUS, SKU) + """
SELECT code, name, brand, category, units_per_case, CAST(total_units // units_per_case AS BIGINT) AS full_cases, CAST(total_units % units_per_case AS BIGINT) AS loose_units, total_units, views
FROM (SELECT sku AS code, count(*) AS total_units, count(DISTINCT commit_id) AS views FROM statused WHERE status = 'inner' GROUP BY sku) JOIN sku USING (code)"""


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["low", "cut", "inner", "band"]
    got = _statused(spark, sf_dir).groupBy("cls").pivot("status", names).agg(F.count(F.lit(1)))
    return got.select("cls", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))


STATUS_COUNTS = with_sql(DETECTIONS, _STATUS) + "SELECT cls, " + ", ".join(f"count(*) FILTER (WHERE status = '{n}') AS \"{n}\"" for n in ("low", "cut", "inner", "band")) + " FROM statused GROUP BY cls"


def naive_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class: views summed without matching, and the same as a share of all (with a total row)."""
    inner = _statused(spark, sf_dir).where("status = 'inner'")
    return inner.rollup("cls").agg(F.count("*").alias("units"), F.countDistinct("commit_id").alias("views")).select(F.coalesce("cls", F.lit("all")).alias("cls"), "units", "views")


NAIVE_SUM = with_sql(DETECTIONS, _STATUS) + "SELECT coalesce(cls, 'all') AS cls, count(*) AS units, count(DISTINCT commit_id) AS views FROM statused WHERE status = 'inner' GROUP BY ROLLUP (cls)"


def visible_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes shifted by an affine transform, clipped, and kept if wider and taller than 2."""
    m = F.array(*(F.lit(v) for v in (1.0, 0.0, 40.0, 0.0, 1.0, 20.0)))
    b = detections(spark, sf_dir)
    moved = g.affine_box(m, g.box())
    at = b.select("commit_id", "det_id", *(c.alias(n) for c, n in zip(moved, d.BOX, strict=True)))
    c = g.clip(g.box(), F.lit(WIDTH), F.lit(HEIGHT))
    return at.where(g.visible(g.box(), F.lit(WIDTH), F.lit(HEIGHT))).select("commit_id", "det_id", *(x.alias(n) for x, n in zip(c, d.BOX, strict=True)))


VISIBLE_BOXES = with_sql(DETECTIONS) + f"""
SELECT * FROM (SELECT commit_id, det_id, greatest(x0 + 40, 0) AS x0, greatest(y0 + 20, 0) AS y0, least(x1 + 40, {WIDTH}::DOUBLE) AS x1, least(y1 + 20, {HEIGHT}::DOUBLE) AS y1 FROM detections)
WHERE x1 - x0 > 2 AND y1 - y0 > 2"""


def warped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes under a homography, their hull's size, and whether the centre lies in a convex zone."""
    h = F.array(*(F.lit(v) for v in (0.9, 0.1, 5.0, -0.1, 1.1, 3.0, 0.0005, 0.0002, 1.0)))
    w = g.warp_box(h, g.box())
    zone = [(F.lit(float(x)), F.lit(float(y))) for x, y in ((10, 10), (90, 20), (100, 80), (20, 90))]
    cx, cy = g.centre(g.box())
    return detections(spark, sf_dir).select("commit_id", "det_id", F.round(w[2] - w[0], 6).alias("wide"), F.round(w[3] - w[1], 6).alias("tall"), g.in_convex(cx, cy, zone).alias("in_zone"))


_H = "(0.9 * {x} + 0.1 * {y} + 5.0) / (0.0005 * {x} + 0.0002 * {y} + 1.0)", "(-0.1 * {x} + 1.1 * {y} + 3.0) / (0.0005 * {x} + 0.0002 * {y} + 1.0)"
_CORNERS = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
_XS, _YS = (", ".join(e.format(x=x, y=y) for x, y in _CORNERS) for e in _H)
_ZONE = [(10, 10), (90, 20), (100, 80), (20, 90)]
_SIDES = [f"(({bx} - {ax}) * (cy - {ay}) - ({by} - {ay}) * (cx - {ax}))" for (ax, ay), (bx, by) in zip(_ZONE, _ZONE[1:] + _ZONE[:1], strict=True)]
WARPED_BOXES = with_sql(DETECTIONS) + f"""
SELECT commit_id, det_id, round(greatest({_XS}) - least({_XS}), 6) AS wide, round(greatest({_YS}) - least({_YS}), 6) AS tall,
  ({' AND '.join(s + ' >= 0' for s in _SIDES)}) OR ({' AND '.join(s + ' <= 0' for s in _SIDES)}) AS in_zone
FROM (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM detections)"""


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.overlapping(detections(spark, sf_dir), 0.05)
    return p.select(F.col("a_commit_id").alias("commit_id"), F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"), F.round("iou", 9).alias("iou"))


_BOTH = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
_IOU = f"({_BOTH}) / greatest({_AREA.format('a')} + {_AREA.format('b')} - {_BOTH}, 1e-9)"
IOU_PAIRS = with_sql(DETECTIONS) + f"""
SELECT a.commit_id, a.det_id AS a, b.det_id AS b, round({_IOU}, 9) AS iou FROM detections a JOIN detections b ON a.commit_id = b.commit_id AND a.det_id < b.det_id WHERE {_IOU} >= 0.05"""


def row_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.row_boxes(detections(spark, sf_dir).withColumn("cls", F.col("side")))


ROW_BOXES = with_sql(DETECTIONS) + f"""
SELECT a.commit_id, a.det_id FROM detections a JOIN detections b ON a.commit_id = b.commit_id AND a.side = b.side AND a.det_id <> b.det_id
WHERE (b.x0 + b.x1) / 2 > a.x0 AND (b.x0 + b.x1) / 2 < a.x1 AND (b.y0 + b.y1) / 2 > a.y0 AND (b.y0 + b.y1) / 2 < a.y1 AND {_AREA.format('b')} < 0.6 * {_AREA.format('a')}
GROUP BY a.commit_id, a.det_id, a.x0, a.y0, a.x1, a.y1 HAVING count(*) >= 2 AND sum({_AREA.format('b')}) > 0.5 * {_AREA.format('a')}"""


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.part_boxes(detections(spark, sf_dir).withColumn("cls", F.col("side")))


PART_BOXES = with_sql(DETECTIONS) + f"""
SELECT DISTINCT a.commit_id, a.det_id FROM detections a JOIN detections b ON a.commit_id = b.commit_id AND a.side = b.side AND a.det_id <> b.det_id
WHERE b.score >= a.score AND {_AREA.format('b')} > {_AREA.format('a')} AND ({_BOTH}) / greatest({_AREA.format('a')}, 1e-9) > 0.8"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression at IoU 0.3, then row and part boxes: what is left per commit."""
    kept = d.clean(detections(spark, sf_dir).withColumn("cls", F.col("side")), 0.3)
    return kept.select("commit_id", "det_id")


CLEANED = "WITH RECURSIVE " + DETECTIONS + f""",
ordered AS (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY score DESC, det_id) AS rank FROM detections),
hits AS (SELECT b.commit_id, b.rank, list(a.rank) AS over FROM ordered a JOIN ordered b ON a.commit_id = b.commit_id AND a.rank < b.rank WHERE {_IOU} >= 0.3 GROUP BY ALL),
step AS (SELECT commit_id, 1::BIGINT AS rank, [1::BIGINT] AS kept FROM ordered WHERE rank = 1
  UNION ALL SELECT o.commit_id, o.rank, CASE WHEN h.over IS NOT NULL AND list_has_any(h.over, s.kept) THEN s.kept ELSE list_append(s.kept, o.rank) END
  FROM step s JOIN ordered o ON o.commit_id = s.commit_id AND o.rank = s.rank + 1 LEFT JOIN hits h ON h.commit_id = o.commit_id AND h.rank = o.rank),
nms AS (SELECT o.* FROM ordered o JOIN (SELECT commit_id, arg_max(kept, rank) AS kept FROM step GROUP BY commit_id) k ON o.commit_id = k.commit_id AND list_contains(k.kept, o.rank)),
rows_ AS (SELECT a.commit_id, a.det_id FROM nms a JOIN nms b ON a.commit_id = b.commit_id AND a.side = b.side AND a.det_id <> b.det_id
  WHERE (b.x0 + b.x1) / 2 > a.x0 AND (b.x0 + b.x1) / 2 < a.x1 AND (b.y0 + b.y1) / 2 > a.y0 AND (b.y0 + b.y1) / 2 < a.y1 AND {_AREA.format('b')} < 0.6 * {_AREA.format('a')}
  GROUP BY a.commit_id, a.det_id, a.x0, a.y0, a.x1, a.y1 HAVING count(*) >= 2 AND sum({_AREA.format('b')}) > 0.5 * {_AREA.format('a')}),
left_ AS (SELECT * FROM nms WHERE (commit_id, det_id) NOT IN (SELECT (commit_id, det_id) FROM rows_))
SELECT commit_id, det_id FROM left_ EXCEPT SELECT a.commit_id, a.det_id FROM left_ a JOIN left_ b ON a.commit_id = b.commit_id AND a.side = b.side AND a.det_id <> b.det_id
WHERE b.score >= a.score AND {_AREA.format('b')} > {_AREA.format('a')} AND ({_BOTH}) / greatest({_AREA.format('a')}, 1e-9) > 0.8"""


def gated_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy S1 for one walk at a time: detections on side O with no counted one of side F nearby."""
    all_ = detections(spark, sf_dir)
    got = d.gated_new(all_.where("side = 'O'"), all_.where("side = 'F'"), 6.0, (1.0, 0.5), ["walk_id", "cls"])
    return got.select("walk_id", "commit_id", "det_id")


GATED_NEW = with_sql(DETECTIONS) + """
SELECT walk_id, commit_id, det_id FROM detections a WHERE side = 'O' AND NOT EXISTS (SELECT 1 FROM detections b WHERE b.side = 'F' AND a.walk_id = b.walk_id AND a.cls = b.cls
  AND ((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) ** 2 + (((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) * 0.5) ** 2 <= 36)"""


def _two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cx, cy = g.centre(g.box())
    all_ = staged(detections(spark, sf_dir).where("side in ('O', 'F')").select("walk_id", "commit_id", "det_id", "cls", "side", cx.alias("cx"), cy.alias("cy"), (F.col("sku") % 7).alias("sku")), "sides")
    key = F.concat_ws("/", F.col("commit_id").cast("string"), "det_id")
    dets = all_.where("side = 'O'").select("walk_id", "cls", key.alias("det_id"), "cx", "cy", "sku")
    items = all_.where("side = 'F'").select("walk_id", "cls", F.col("cx").alias("ix"), F.col("cy").alias("iy"), F.col("sku").alias("item_sku"))
    return dets, items


_SIDES_SQL = """dets AS (SELECT walk_id, cls, concat_ws('/', commit_id, det_id) AS det_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, sku % 7 AS sku FROM detections WHERE side = 'O'),
items AS (SELECT walk_id, cls, (x0 + x1) / 2 AS ix, (y0 + y1) / 2 AS iy, sku % 7 AS item_sku FROM detections WHERE side = 'F'),
cands AS (SELECT DISTINCT walk_id, round((ix - cx) / 2) * 2 AS dx, round((iy - cy) / 2) * 2 AS dy FROM dets JOIN items USING (walk_id, cls) WHERE abs(ix - cx) <= 12 AND abs(iy - cy) <= 12
  UNION SELECT DISTINCT walk_id, 0.0::DOUBLE, 0.0::DOUBLE FROM dets),
hits AS (SELECT walk_id, dx, dy, det_id, arg_min(sku = item_sku, (hypot_, sku <> item_sku)) AS agree
  FROM (SELECT *, sqrt((cx + dx - ix) ** 2 + (cy + dy - iy) ** 2) AS hypot_ FROM dets JOIN cands USING (walk_id) JOIN items USING (walk_id, cls)) WHERE hypot_ <= 4 GROUP BY ALL),
votes AS (SELECT walk_id, dx, dy, sum(CASE WHEN agree THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS votes FROM hits GROUP BY ALL)"""


def offset_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets, items = _two_sides(spark, sf_dir)
    c = d.offset_candidates(dets, items, ["walk_id"], 12.0, 2.0)
    return c.select("walk_id", (F.col("dx") + 0.0).alias("dx"), (F.col("dy") + 0.0).alias("dy"))


OFFSET_CANDIDATES = with_sql(DETECTIONS, _SIDES_SQL) + "SELECT walk_id, dx + 0.0 AS dx, dy + 0.0 AS dy FROM cands"


def offset_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets, items = _two_sides(spark, sf_dir)
    votes = d.offset_votes(dets, items, staged(d.offset_candidates(dets, items, ["walk_id"], 12.0, 2.0), "offsets"), ["walk_id"], 4.0, 13.0)  # rounded, 12 is at most 13
    won = d.best_offset(votes, dets.groupBy("walk_id").agg(F.count("*").alias("n")), ["walk_id"], 1.0)
    return won.select("walk_id", (F.col("dx") + 0.0).alias("dx"), (F.col("dy") + 0.0).alias("dy"), "support")


OFFSET_VOTES = with_sql(DETECTIONS, _SIDES_SQL) + """
SELECT walk_id, CASE WHEN ok THEN o[2] ELSE 0.0 END + 0.0 AS dx, CASE WHEN ok THEN o[3] ELSE 0.0 END + 0.0 AS dy, coalesce(support, 0.0) AS support
FROM (SELECT n.walk_id, o, support, coalesce(support >= greatest(3.0, 0.25 * n), false) AS ok FROM (SELECT walk_id, count(*) AS n FROM dets GROUP BY walk_id) n
  LEFT JOIN (SELECT walk_id, min([sqrt(dx ** 2 + dy ** 2), dx, dy]) AS o, max(top) AS support FROM (SELECT *, max(votes) OVER (PARTITION BY walk_id) AS top FROM votes) WHERE votes >= top - 1 GROUP BY walk_id) w
  ON n.walk_id = w.walk_id)"""


def zone_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in a zone of an earlier commit of the same walk; zones are the hulls of a commit's centres."""
    all_ = detections(spark, sf_dir)
    c = commits(spark, sf_dir).select("commit_id", "n")
    cx, cy = g.centre(g.box())
    zones = all_.groupBy("walk_id", "commit_id").agg(F.min(cx).alias("zx0"), F.min(cy).alias("zy0"), F.max(cx).alias("zx1"), F.max(cy).alias("zy1")).join(c, "commit_id").select("walk_id", F.col("n").alias("zone_n"), "zx0", "zy0", "zx1", "zy1")
    return d.in_any_zone(all_.join(c, "commit_id"), zones, ["walk_id"]).select("walk_id", "commit_id", "det_id")


_ZONES_SQL = """z AS (SELECT d.walk_id, c.n AS zone_n, min((x0 + x1) / 2) AS zx0, min((y0 + y1) / 2) AS zy0, max((x0 + x1) / 2) AS zx1, max((y0 + y1) / 2) AS zy1 FROM detections d JOIN commits c USING (commit_id) GROUP BY ALL)"""
ZONE_PROMPTS = with_sql(DETECTIONS, COMMITS, _ZONES_SQL) + """
SELECT d.walk_id, d.commit_id, d.det_id FROM detections d JOIN commits c USING (commit_id)
WHERE EXISTS (SELECT 1 FROM z WHERE z.walk_id = d.walk_id AND z.zone_n < c.n AND (x0 + x1) / 2 BETWEEN zx0 AND zx1 AND (y0 + y1) / 2 BETWEEN zy0 AND zy1)"""


def drift_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with over 30 percent of their detections in zones of earlier commits."""
    prompts = zone_prompts(spark, sf_dir).groupBy("commit_id").agg(F.count("*").alias("hits"))
    all_ = detections(spark, sf_dir).groupBy("commit_id").agg(F.count("*").alias("n"))
    return all_.join(prompts, "commit_id").where("hits > 0.3 * n").select("commit_id", "hits", "n")


DRIFT_ALARM = f"SELECT commit_id, hits, n FROM (SELECT commit_id, count(*) AS hits FROM ({ZONE_PROMPTS}) GROUP BY commit_id) JOIN (SELECT l_orderkey AS commit_id, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey) USING (commit_id) WHERE hits > 0.3 * n"


def view_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items inside each of a grid of views, fully visible and seen with a recall drawn from the keys."""
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), (F.col("p_partkey") % 997).cast("double").alias("x"), (F.col("p_size") * 4).cast("double").alias("y"), F.col("p_size").alias("w"))
    views = spark.range(60).select(F.col("id").alias("view_id"), (F.col("id") * 16).cast("double").alias("vx0"), (F.col("id") % 3 * 60).cast("double").alias("vy0"))
    views = views.withColumn("vx1", F.col("vx0") + 40).withColumn("vy1", F.col("vy0") + 80)
    seen = d.view_items(items, views, 40.0)
    full = (F.least(F.col("x") - F.col("vx0"), F.col("vx1") - F.col("x")) >= F.col("w") / 10.0) & ((F.col("item_id") * 31 + F.col("view_id") * 17) % 100 < 97)
    return seen.where(full).select("view_id", "item_id")


VIEW_RANGE_JOIN = """
SELECT view_id, item_id FROM (SELECT p_partkey AS item_id, CAST(p_partkey % 997 AS DOUBLE) AS x, p_size * 4 AS y, p_size AS w FROM part)
JOIN (SELECT range AS view_id, range * 16 AS vx0, range % 3 * 60 AS vy0 FROM range(60)) ON x BETWEEN vx0 AND vx0 + 40 AND y BETWEEN vy0 AND vy0 + 80
WHERE least(x - vx0, vx0 + 40 - x) >= w / 10.0 AND (item_id * 31 + view_id * 17) % 100 < 97"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered pairs of commits of a walk: those whose keys agree in a digit; inliers from the keys."""
    c = commits(spark, sf_dir)
    a = c.select("walk_id", F.col("n").alias("a"), F.col("commit_id").alias("ka"), F.col("t").alias("ta"))
    b = c.select(F.col("walk_id").alias("w"), F.col("n").alias("b"), F.col("commit_id").alias("kb"), F.col("t").alias("tb"))
    return a.join(b, (F.col("walk_id") == F.col("w")) & (F.col("a") < F.col("b")) & (F.col("ka") % 3 == F.col("kb") % 3)).withColumn("inliers", 40 + (F.col("ka") * 7 + F.col("kb") * 13) % 60).drop("w")


_LINKS_SQL = """links AS (SELECT x.walk_id, x.n AS a, y.n AS b, x.commit_id AS ka, y.commit_id AS kb, x.t AS ta, y.t AS tb, 40 + (x.commit_id * 7 + y.commit_id * 13) % 60 AS inliers
  FROM commits x JOIN commits y ON x.walk_id = y.walk_id AND x.n < y.n AND x.commit_id % 3 = y.commit_id % 3)"""


def keyframe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("walk_id", "a", "b", "inliers")


KEYFRAME_LINKS = with_sql(COMMITS, _LINKS_SQL) + "SELECT walk_id, a, b, inliers FROM links"


def best_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product of a walk carried into each later commit through the best-registered commit that saw it."""
    c = commits(spark, sf_dir).select("commit_id", "n")
    s = detections(spark, sf_dir).join(c, "commit_id").select("walk_id", "cls", F.col("n").alias("seen_in")).distinct()
    got = s.join(_links(spark, sf_dir).withColumnRenamed("walk_id", "w"), (F.col("walk_id") == F.col("w")) & (F.col("seen_in") == F.col("a")))
    best = got.groupBy("walk_id", "cls", "b").agg(F.max(F.struct("inliers", "a")).alias("m"))
    return best.select("walk_id", "cls", F.col("b").alias("commit_n"), F.col("m.a").alias("via"), F.col("m.inliers").alias("inliers"))


BEST_SIGHTINGS = with_sql(DETECTIONS, COMMITS, _LINKS_SQL) + """
SELECT walk_id, cls, b AS commit_n, max((inliers, a))[2] AS via, max((inliers, a))[1] AS inliers
FROM (SELECT DISTINCT d.walk_id, d.cls, c.n AS a FROM detections d JOIN commits c USING (commit_id)) JOIN links USING (walk_id, a) GROUP BY walk_id, cls, b"""


def late_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked commits more than 10 days and 2 commits apart."""
    return _links(spark, sf_dir).where("tb - ta > 10 and b - a > 2").groupBy("walk_id").agg(F.count("*").alias("revisits"), F.max(F.col("b") - F.col("a")).alias("farthest"))


LATE_REVISITS = with_sql(COMMITS, _LINKS_SQL) + "SELECT walk_id, count(*) AS revisits, max(b - a) AS farthest FROM links WHERE tb - ta > 10 AND b - a > 2 GROUP BY walk_id"


def _knn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The neighbours of every row with an id divisible by 20 among all other rows."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return d.knn(v.where("id % 20 = 0"), v, k)


def knn_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 3).select("q", "rank", "g")


_KNN = """knn AS (SELECT q, rank, g, sim FROM (SELECT a.vec_id AS q, b.vec_id AS g, s AS sim, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS BIGINT) AS rank
  FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a JOIN embeddings b ON a.vec_id <> b.vec_id,
  LATERAL (SELECT round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS s)) WHERE rank <= 3)"""
KNN_TOP3 = with_sql(_KNN) + "SELECT q, rank, g FROM knn"


def knn_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-1 and top-3 accuracy of the teach-once suggestion against the labels."""
    names = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    k = _knn(spark, sf_dir, 3)
    j = k.join(names.select(F.col("vec_id").alias("q"), F.col("label").alias("truth")), "q").join(names.select(F.col("vec_id").alias("g"), F.col("label").alias("guess")), "g")
    per = j.groupBy("q", "truth").agg(F.max(F.when((F.col("rank") == 1) & (F.col("truth") == F.col("guess")), 1).otherwise(0)).alias("one"), F.max((F.col("truth") == F.col("guess")).cast("int")).alias("three"))
    return per.groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("queries"), F.sum("one").alias("top1"), F.sum("three").alias("top3"))


KNN_ACCURACY = with_sql(_KNN) + """
SELECT truth AS label, count(*) AS queries, CAST(sum(one) AS BIGINT) AS top1, CAST(sum(three) AS BIGINT) AS top3
FROM (SELECT q, e.label AS truth, max(CASE WHEN rank = 1 AND e.label = f.label THEN 1 ELSE 0 END) AS one, max(CAST(e.label = f.label AS INT)) AS three
  FROM knn JOIN embeddings e ON e.vec_id = q JOIN embeddings f ON f.vec_id = g GROUP BY q, e.label) GROUP BY truth"""


def ratio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours that are closer than 0.98 of the second, by distance (J13; descriptors are unit vectors)."""
    k = _knn(spark, sf_dir, 2)
    two = k.groupBy("q").agg(F.min_by("g", "rank").alias("g"), F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("s2"))
    return two.where(F.sqrt(2 - 2 * F.col("s1")) < 0.98 * F.sqrt(2 - 2 * F.col("s2"))).select("q", "g")


RATIO_MATCHES = with_sql(_KNN) + """
SELECT q, g FROM (SELECT q, arg_min(g, rank) AS g, max(CASE WHEN rank = 1 THEN sim END) AS s1, max(CASE WHEN rank = 2 THEN sim END) AS s2 FROM knn WHERE rank <= 2 GROUP BY q)
WHERE sqrt(2 - 2 * s1) < 0.98 * sqrt(2 - 2 * s2)"""


def view_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each view against its truth (here: all lines of the order) by class: error percentiles."""
    got = _statused(spark, sf_dir).where("status <> 'low'").groupBy("commit_id", "cls").agg(F.count("*").alias("got"))
    truth = detections(spark, sf_dir).groupBy("commit_id", "cls").agg(F.count("*").alias("truth"))
    e = truth.join(got, ["commit_id", "cls"], "left").withColumn("e", F.abs(F.coalesce("got", F.lit(0)) - F.col("truth")) / F.col("truth"))
    return e.groupBy("cls").agg(F.round(F.median("e"), 6).alias("median_error"), F.round(F.percentile("e", 0.9), 6).alias("p90_error"), F.sum(F.coalesce("got", F.lit(0))).alias("got"), F.sum("truth").alias("truth")).withColumn("percent", percent_error(F.col("got"), F.col("truth")))


VIEW_ERRORS = with_sql(DETECTIONS, _STATUS) + """
SELECT cls, round(median(e), 6) AS median_error, round(quantile_cont(e, 0.9), 6) AS p90_error, CAST(sum(got) AS BIGINT) AS got, CAST(sum(truth) AS BIGINT) AS truth,
  CASE WHEN sum(truth) = 0 THEN 'n/a' ELSE printf('%+.0f%%', round_even(100.0 * (sum(got) - sum(truth)) / sum(truth), 0)) END AS percent
FROM (SELECT *, abs(got - truth) / truth AS e FROM (SELECT commit_id, cls, count(*) FILTER (WHERE status <> 'low') AS got, count(*) AS truth FROM statused GROUP BY commit_id, cls)) GROUP BY cls"""


def truth_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and got status counts side by side, only where they differ; absent statuses count 0."""
    s = _statused(spark, sf_dir).select("walk_id", "status", "side")
    a = s.where("side = 'O'").groupBy("walk_id", "status").agg(F.count("*").alias("expected"))
    b = s.where("side = 'F'").groupBy("walk_id", "status").agg(F.count("*").alias("got"))
    j = a.join(b, ["walk_id", "status"], "full").select("walk_id", "status", F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("got", F.lit(0)).cast("long").alias("got"))
    return j.where("expected <> got")


TRUTH_MISMATCHES = with_sql(DETECTIONS, _STATUS) + """
SELECT * FROM (SELECT walk_id, status, count(*) FILTER (WHERE side = 'O') AS expected, count(*) FILTER (WHERE side = 'F') AS got FROM statused GROUP BY walk_id, status) WHERE expected <> got"""


def times_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each product was counted: never, once, twice or more, extra counts."""
    n = _statused(spark, sf_dir).where("status = 'inner'").groupBy(F.col("sku").alias("code")).agg(F.count("*").alias("n"))
    j = sku(spark, sf_dir).join(n, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.groupBy("category").agg(F.count_if(F.col("n") == 0).alias("never"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("twice_or_more"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).cast("long").alias("extra"))


TIMES_COUNTED = with_sql(DETECTIONS, _STATUS, SKU) + """
SELECT category, count(*) FILTER (WHERE n = 0) AS never, count(*) FILTER (WHERE n = 1) AS once, count(*) FILTER (WHERE n > 1) AS twice_or_more, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS extra
FROM (SELECT category, coalesce(n, 0) AS n FROM sku LEFT JOIN (SELECT sku AS code, count(*) AS n FROM statused WHERE status = 'inner' GROUP BY sku) USING (code)) GROUP BY category"""


def first_frame_in_rack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first commit of each walk with a status, else the walk's first."""
    c = commits(spark, sf_dir)
    f = c.where("status = 'P'").groupBy("walk_id").agg(F.min_by("commit_id", "n").alias("anchor"))
    base = c.groupBy("walk_id").agg(F.min_by("commit_id", "n").alias("first"))
    return base.join(f, "walk_id", "left").select("walk_id", F.coalesce("anchor", "first").alias("anchor"))


FIRST_FRAME_IN_RACK = with_sql(COMMITS) + "SELECT walk_id, coalesce(arg_min(commit_id, n) FILTER (WHERE status = 'P'), arg_min(commit_id, n)) AS anchor FROM commits GROUP BY walk_id"


def last_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three commits of each walk, newest first."""
    c = commits(spark, sf_dir).withColumn("back", F.row_number().over(Window.partitionBy("walk_id").orderBy(F.desc("n"))).cast("long"))
    return c.where("back <= 3").select("walk_id", "back", "commit_id")


LAST_THREE = with_sql(COMMITS) + "SELECT walk_id, back, commit_id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY walk_id ORDER BY n DESC) AS BIGINT) AS back FROM commits) WHERE back <= 3"


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by the sides that saw them: union, both, one without the other."""
    s = detections(spark, sf_dir).select("cls", "sku", "side")
    o, f = (s.where(F.col("side") == x).select("cls", "sku") for x in "OF")
    tagged = [o.union(f).distinct().withColumn("kind", F.lit("either")), o.intersect(f).withColumn("kind", F.lit("both")), o.join(f, ["cls", "sku"], "left_anti").distinct().withColumn("kind", F.lit("only_o")), o.unionAll(f).withColumn("kind", F.lit("sightings"))]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy("cls", "kind").agg(F.count("*").alias("n"))


SET_OPERATIONS = with_sql(DETECTIONS, "o AS (SELECT cls, sku FROM detections WHERE side = 'O'), f AS (SELECT cls, sku FROM detections WHERE side = 'F')") + """
SELECT cls, kind, count(*) AS n FROM (SELECT *, 'either' AS kind FROM (FROM o UNION FROM f) UNION ALL SELECT *, 'both' FROM (FROM o INTERSECT FROM f)
  UNION ALL SELECT *, 'only_o' FROM (FROM o EXCEPT FROM f) UNION ALL SELECT *, 'sightings' FROM (FROM o UNION ALL FROM f)) GROUP BY ALL"""


_NAMES = (
    "stock_sheet status_counts naive_sum visible_boxes warped_boxes iou_pairs row_boxes part_boxes cleaned gated_new offset_candidates offset_votes zone_prompts drift_alarm view_range_join "
    "keyframe_links best_sightings late_revisits knn_top3 knn_accuracy ratio_matches view_errors truth_mismatches times_counted first_frame_in_rack last_three set_operations"
).split()
QUERIES = {("q01_" if n == "stock_sheet" else f"q{i + 19:02d}_") + n: globals()[n] for i, n in enumerate(_NAMES)}
ORACLE_SQL = {("q01_" if n == "stock_sheet" else f"q{i + 19:02d}_") + n: globals()[n.upper()] for i, n in enumerate(_NAMES)}
