"""Queries of the relational side, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.functions.text import escape_cell, gtin14, known_classes, literal_table
from stockloom.operators import ledger
from stockloom.operators.graph import connected_components
from stockloom.plans.detections import _STATUS, _statused
from stockloom.plans.index import offsets
from stockloom.sources.adapters import DETECTIONS, FRAMES, SKU, frames, sku, with_sql
from stockloom.sources.tables import table


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statused(spark, sf_dir).where("status = 'inner'").groupBy(F.col("sku").alias("code")).agg(F.count("*").alias("units"))


def _manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual lines: orders of status P, one product each."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return o.select((F.col("o_orderkey") % 997).alias("code"), (F.col("o_custkey") % 4).alias("full_cases"), (F.col("o_orderkey") % 5).alias("loose_units"))


_LINES = """counted AS (SELECT sku AS code, count(*) AS units FROM statused WHERE status = 'inner' GROUP BY sku),
manual AS (SELECT o_orderkey % 997 AS code, o_custkey % 4 AS full_cases, o_orderkey % 5 AS loose_units FROM orders WHERE o_orderstatus = 'P'),
lines AS (SELECT sku.*, total_units, CAST(total_units // units_per_case AS BIGINT) AS full_cases, CAST(total_units % units_per_case AS BIGINT) AS loose_units
  FROM (SELECT code, CAST(sum(units) AS BIGINT) AS total_units FROM (SELECT * FROM counted UNION ALL SELECT code, full_cases * units_per_case + loose_units FROM manual JOIN sku USING (code)) GROUP BY code) JOIN sku USING (code))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.stock_lines(_counted(spark, sf_dir), _manual(spark, sf_dir), sku(spark, sf_dir))


def stock_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("code", "name", "brand", "category", "units_per_case", "full_cases", "loose_units", "total_units")


STOCK_LINES = with_sql(DETECTIONS, _STATUS, SKU, _LINES) + "SELECT code, name, brand, category, units_per_case, full_cases, loose_units, total_units FROM lines"


def live_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list by brand with a text filter: units and products."""
    return _lines(spark, sf_dir).where(F.lower("category").contains("an")).groupBy("brand").agg(F.sum("total_units").alias("units"), F.countDistinct("code").alias("products"))


LIVE_LIST = with_sql(DETECTIONS, _STATUS, SKU, _LINES) + "SELECT brand, CAST(sum(total_units) AS BIGINT) AS units, count(DISTINCT code) AS products FROM lines WHERE contains(lower(category), 'an') GROUP BY brand"


def zero_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.zero_lines(sku(spark, sf_dir), _lines(spark, sf_dir).select("code", "total_units")).select("code", "total_units")


ZERO_LINES = with_sql(DETECTIONS, _STATUS, SKU, _LINES) + "SELECT sku.code, coalesce(total_units, 0) AS total_units FROM sku LEFT JOIN lines USING (code)"


def bay_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).rollup("category", "brand").agg(F.sum("total_units").alias("units"), F.count("*").alias("lines"), F.grouping_id().alias("level")).select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("brand", F.lit("all")).alias("brand"), "units", "lines", F.col("level").cast("long").alias("level"))


BAY_ROLLUP = with_sql(DETECTIONS, _STATUS, SKU, _LINES) + """
SELECT coalesce(category, 'all') AS category, coalesce(brand, 'all') AS brand, CAST(sum(total_units) AS BIGINT) AS units, count(*) AS lines, CAST(grouping(category, brand) AS BIGINT) AS level FROM lines GROUP BY ROLLUP (category, brand)"""


def export_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 export columns as text; barcodes stay text, cells that look like formulas are escaped (K9)."""
    lines = _lines(spark, sf_dir)
    note = F.when(F.col("loose_units") == 0, F.concat(F.lit("=cases "), F.col("full_cases").cast("string"))).otherwise("")
    text = {"session_id": F.lit("S1"), "venue": F.lit("V1"), "zone": F.col("category"), "counted_at": F.lit("2024-01-30"), "counted_by": F.lit("-"), "sku_code": gtin14(F.col("code").cast("string")), "sku_name": F.col("name"), "brand": F.col("brand"), "category": F.col("category"), "size_ml": F.lit("0")}
    numbers = ["units_per_case", "full_cases", "loose_units", "total_units"]
    return lines.select(*(escape_cell(v).alias(k) for k, v in text.items()), *(F.col(n).cast("string").alias(n) for n in numbers), F.lit("scan").alias("source"), escape_cell(note).alias("notes"))


_GTIN = "lpad(CAST(code AS VARCHAR), 13, '0')"
EXPORT_SHEET = with_sql(DETECTIONS, _STATUS, SKU, _LINES) + f"""
SELECT 'S1' AS session_id, 'V1' AS venue, category AS zone, '2024-01-30' AS counted_at, '''-' AS counted_by,
  {_GTIN} || CAST((10 - list_sum(list_transform(range(1, 14), lambda i: CAST(substr({_GTIN}, CAST(i AS BIGINT), 1) AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 AS VARCHAR) AS sku_code,
  name AS sku_name, brand, category, '0' AS size_ml, CAST(units_per_case AS VARCHAR) AS units_per_case, CAST(full_cases AS VARCHAR) AS full_cases, CAST(loose_units AS VARCHAR) AS loose_units,
  CAST(total_units AS VARCHAR) AS total_units, 'scan' AS source, CASE WHEN loose_units = 0 THEN '''=cases ' || full_cases ELSE '' END AS notes FROM lines"""


def catalogue_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows whose mapped code repeats (SC10)."""
    c = sku(spark, sf_dir).withColumn("mapped", F.concat_ws("-", "brand", F.col("units_per_case").cast("string")))
    n = F.count("*").over(Window.partitionBy("mapped"))
    return c.withColumn("n", n).where("n > 1").select("code", "mapped", "n")


CATALOGUE_DUPLICATES = with_sql(SKU) + "SELECT code, mapped, n FROM (SELECT code, concat_ws('-', brand, units_per_case) AS mapped, count(*) OVER (PARTITION BY concat_ws('-', brand, units_per_case)) AS n FROM sku) WHERE n > 1"


SIZES = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")


def truth_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals against a literal table of truth; classes without a truth stay (SC5, J15)."""
    truth = spark.range(1).select(F.explode(known_classes(literal_table(F.lit("STANDARD = 100, SMALL=200,LARGE =300")), SIZES)).alias("cls", "truth"))
    got = _statused(spark, sf_dir).where("status = 'inner'").groupBy(F.element_at(F.split("cls", " "), 1).alias("cls")).agg(F.count("*").alias("got"))
    return got.join(F.broadcast(truth), "cls", "left").select("cls", "got", "truth")


TRUTH_LITERAL = with_sql(DETECTIONS, _STATUS) + """
SELECT cls, got, truth FROM (SELECT string_split(cls, ' ')[1] AS cls, count(*) AS got FROM statused WHERE status = 'inner' GROUP BY 1)
LEFT JOIN (VALUES ('STANDARD', 100::BIGINT), ('SMALL', 200), ('LARGE', 300)) t(cls, truth) USING (cls)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sku(spark, sf_dir).select(F.col("code").alias("group_id"), F.concat_ws("-", "brand", F.col("units_per_case").cast("string")).alias("case_gtin"), (F.col("code") % 3 != 0).alias("confirmed"))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_case = sku(spark, sf_dir).where("code % 2 = 0").select(F.concat_ws("-", "brand", F.col("units_per_case").cast("string")).alias("case_gtin"), "code")
    by_print = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("group_id"), F.col("label").cast("long").alias("code"))
    return ledger.suggestions(_groups(spark, sf_dir), by_case, by_print).select("group_id", "suggested", "source", "exported")


SUGGESTIONS = with_sql(SKU) + """
SELECT g.code AS group_id, coalesce(case_code, print_code) AS suggested, CASE WHEN case_code IS NOT NULL THEN 'case' WHEN print_code IS NOT NULL THEN 'taught' ELSE 'none' END AS source,
  CASE WHEN g.code % 3 <> 0 THEN coalesce(case_code, print_code) END AS exported
FROM (SELECT *, concat_ws('-', brand, units_per_case) AS gtin FROM sku) g
LEFT JOIN (SELECT concat_ws('-', brand, units_per_case) AS gtin, min(code) AS case_code FROM sku WHERE code % 2 = 0 GROUP BY 1) USING (gtin)
LEFT JOIN (SELECT vec_id AS code, CAST(label AS BIGINT) AS print_code FROM embeddings) p ON p.code = g.code"""


def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest quantity and type of each session's log."""
    e = frames(spark, sf_dir)
    return ledger.latest_state(e, "walk_id", ["us", "frame"], ["kind", "px"])


SESSION_STATE = with_sql(FRAMES) + "SELECT walk_id, arg_max(kind, (us, frame)) AS kind, arg_max(px, (us, frame)) AS px FROM frames GROUP BY walk_id"
_ACTIONS = ("finish", "lock", "resume", "reopen")


def lifecycle_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames(spark, sf_dir).withColumn("action", F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("px") % 4 + 1).cast("int")))
    return ledger.lifecycle_errors(e, "walk_id", ["frame"], "action").select("walk_id", "frame", "state", "action")


_AFTER = "CASE state || '/' || action " + " ".join(f"WHEN '{s}/{a}' THEN '{t}'" for (s, a), t in ledger.LIFECYCLE.items())
LIFECYCLE_ERRORS = "WITH RECURSIVE " + FRAMES + f""",
acts AS (SELECT walk_id, frame, ['finish', 'lock', 'resume', 'reopen'][CAST(px % 4 + 1 AS BIGINT)] AS action FROM frames),
walked AS (SELECT walk_id, frame, 'open' AS state, action FROM acts WHERE frame = 1
  UNION ALL SELECT walk_id, frame + 1, {_AFTER} ELSE state END, next FROM walked JOIN (SELECT walk_id AS nw, frame AS nf, action AS next FROM acts) ON nw = walk_id AND nf = frame + 1)
SELECT walk_id, frame, state, action FROM walked WHERE ({_AFTER} END) IS NULL"""


def review_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a session from being locked: unnamed groups block; products never counted and views without counts warn."""
    s = _statused(spark, sf_dir)
    unnamed = _groups(spark, sf_dir).where("not confirmed").select(F.lit("unnamed").alias("kind"), F.col("group_id").alias("ref"))
    never = sku(spark, sf_dir).join(_counted(spark, sf_dir), "code", "left_anti").select(F.lit("never_counted").alias("kind"), F.col("code").alias("ref"))
    inner = F.max(F.coalesce(F.col("status") == "inner", F.lit(False)))  # one pass: the views are not made twice and compared
    empty = s.groupBy("commit_id").agg(inner.alias("inner")).where("not inner").select(F.lit("no_counts").alias("kind"), F.col("commit_id").alias("ref"))
    return unnamed.unionByName(never).unionByName(empty)


REVIEW_BLOCKERS = with_sql(DETECTIONS, _STATUS, SKU) + """
SELECT 'unnamed' AS kind, code AS ref FROM sku WHERE code % 3 = 0 UNION ALL
SELECT 'never_counted', code FROM sku WHERE code NOT IN (SELECT sku FROM statused WHERE status = 'inner') UNION ALL
(SELECT 'no_counts', commit_id FROM statused EXCEPT SELECT 'no_counts', commit_id FROM statused WHERE status = 'inner')"""


def open_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large boxes that hold a unit's centre count as their units (P25): what is left to count."""
    s = _statused(spark, sf_dir).where("status <> 'low'").withColumn("is_case", (F.col("x1") - F.col("x0")) > 35)
    unit = s.where("not is_case").select(F.col("commit_id").alias("c"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    shut = s.where("is_case").join(unit, (F.col("commit_id") == F.col("c")) & F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1")), "left_anti")
    return s.where("not is_case").unionByName(shut).groupBy("commit_id").agg(F.count("*").alias("units"), F.count_if("is_case").alias("cases"))


OPEN_CASES = with_sql(DETECTIONS, _STATUS, "s AS (SELECT *, x1 - x0 > 35 AS is_case FROM statused WHERE status <> 'low')") + """
SELECT commit_id, count(*) AS units, count(*) FILTER (WHERE is_case) AS cases FROM s a
WHERE NOT is_case OR NOT EXISTS (SELECT 1 FROM s b WHERE NOT b.is_case AND a.commit_id = b.commit_id AND (b.x0 + b.x1) / 2 BETWEEN a.x0 AND a.x1 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 AND a.y1) GROUP BY commit_id"""


def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics against limits, a row each."""
    s = _statused(spark, sf_dir)
    share = s.agg(F.avg((F.col("status") == "low").cast("double")).alias("low"), F.avg((F.col("status") == "cut").cast("double")).alias("cut"), F.percentile("score", 0.05).alias("p5"), F.median("score").alias("p50"))
    rows = F.array(ledger.gate("low share", F.col("low"), 0.3), ledger.gate("cut share", F.col("cut"), 0.5), ledger.gate("score p5", F.col("p5"), 0.9, False), ledger.gate("score p50", F.col("p50"), 0.9, False))
    return share.select(F.inline(rows))


QUALITY_GATES = with_sql(DETECTIONS, _STATUS) + """
SELECT gate, round(value, 6) AS value, lim AS "limit", CASE WHEN CASE WHEN most THEN value <= lim ELSE value >= lim END THEN 'pass' ELSE 'fail' END AS verdict
FROM (SELECT avg(CAST(status = 'low' AS DOUBLE)) AS low, avg(CAST(status = 'cut' AS DOUBLE)) AS cut, quantile_cont(score, 0.05) AS p5, median(score) AS p50 FROM statused),
LATERAL (VALUES ('low share', low, 0.3::DOUBLE, true), ('cut share', cut, 0.5, true), ('score p5', p5, 0.9, false), ('score p50', p50, 0.9, false)) v(gate, value, lim, most)"""


def detector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and shown boxes at each score from the best down."""
    s = _statused(spark, sf_dir).select(F.round("score", 2).alias("score"), (F.col("status") == "inner").cast("long").alias("hit"))
    return ledger.precision_recall(s, "hit", "score")


DETECTOR_METRICS = with_sql(DETECTIONS, _STATUS) + """
SELECT score, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS hits, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) AS shown, CAST(sum(p) OVER () AS BIGINT) AS positives
FROM (SELECT round(score, 2) AS score, count(*) FILTER (WHERE status = 'inner') AS p, count(*) AS n FROM statused GROUP BY 1)"""


def flywheel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training labels from what people did: removed items are false positives, accepted prompts false negatives."""
    e = frames(spark, sf_dir)
    fp = e.where("kind = 'error'").select(F.lit("false_positive").alias("label"), "walk_id", "frame")
    fn = e.where("kind = 'purchase' and px < 20").select(F.lit("false_negative").alias("label"), "walk_id", "frame")
    return fp.unionByName(fn)


FLYWHEEL_LABELS = with_sql(FRAMES) + "SELECT 'false_positive' AS label, walk_id, frame FROM frames WHERE kind = 'error' UNION ALL SELECT 'false_negative', walk_id, frame FROM frames WHERE kind = 'purchase' AND px < 20"


def lifted_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each commit's boxes: median of confident pixels, else the shelf plane's."""
    s = _statused(spark, sf_dir)
    per = s.groupBy("walk_id", "commit_id").agg(F.percentile(F.when(F.col("score") >= 0.95, F.col("y1") - F.col("y0")), 0.5).alias("own"))
    plane = s.groupBy("walk_id").agg(F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("plane"))
    return per.join(plane, "walk_id").select("commit_id", F.round(F.coalesce("own", "plane"), 6).alias("depth"), F.col("own").isNull().alias("fallback"))


LIFTED_DEPTH = with_sql(DETECTIONS, _STATUS) + """
SELECT commit_id, round(coalesce(own, plane), 6) AS depth, own IS NULL AS fallback
FROM (SELECT walk_id, commit_id, median(y1 - y0) FILTER (WHERE score >= 0.95) AS own FROM statused GROUP BY ALL) JOIN (SELECT walk_id, median(y1 - y0) AS plane FROM statused GROUP BY walk_id) USING (walk_id)"""


def look_alike_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical-looking items of one commit (50 items) grouped: similarity pairs, then connected components."""
    e = table(spark, sf_dir, "embeddings").withColumn("commit", F.floor(F.col("vec_id") / 50))
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"), "commit"), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"), "commit")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    groups = connected_components(a.join(b, "commit").where("a < b").where(F.round(dot, 9) >= 0.25).select("a", "b"))
    return e.select(F.col("vec_id").alias("node")).join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


LOOK_ALIKE_GROUPS = """WITH RECURSIVE pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id // 50 = y.vec_id // 50 AND x.vec_id <> y.vec_id
  WHERE round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) >= 0.25),
walk AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT w.node, p.b FROM walk w JOIN pairs p ON p.a = w.seen)
SELECT node, min(seen) AS component FROM walk GROUP BY node"""


def op_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of node kinds by depth over a tree of regions, nations and suppliers."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = r.select(F.lit("model").alias("parent"), name("r", "r_regionkey").alias("child"), F.lit("function").alias("kind"))
    edges = edges.unionByName(n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"), F.lit("block").alias("kind")))
    edges = edges.unionByName(s.select(name("n", "s_nationkey").alias("parent"), name("s", "s_suppkey").alias("child"), F.when(F.col("s_suppkey") % 3 == 0, "topk").otherwise("conv").alias("kind")))
    return ledger.op_tree_histogram(edges, "model")


OP_INVENTORY = """WITH RECURSIVE edges AS (SELECT 'model' AS parent, 'r' || r_regionkey AS child, 'function' AS kind FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'block' FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'topk' ELSE 'conv' END FROM supplier),
tree AS (SELECT child AS node, kind, 1::BIGINT AS depth FROM edges WHERE parent = 'model' UNION ALL SELECT e.child, e.kind, t.depth + 1 FROM tree t JOIN edges e ON e.parent = t.node)
SELECT kind, depth, count(*) AS n FROM tree GROUP BY kind, depth"""


def coco_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations as in a COCO document: boxes as x, y, w, h, dense ids from 1, categories by number (K3)."""
    s = _statused(spark, sf_dir).where(F.col("score") >= 0.97)
    cats = s.select("cls").distinct().withColumn("category_id", F.row_number().over(Window.orderBy("cls")).cast("long"))
    within = F.row_number().over(Window.partitionBy("commit_id").orderBy("det_id"))
    one = s.join(cats, "cls").withColumn("_w", within).join(offsets(s, "commit_id"), "commit_id")
    w, h = F.round(F.col("x1") - F.col("x0"), 1), F.round(F.col("y1") - F.col("y0"), 1)
    return one.select((F.col("before") + F.col("_w")).cast("long").alias("id"), F.col("commit_id").alias("image_id"), "category_id", F.round("x0", 1).alias("x"), F.round("y0", 1).alias("y"), w.alias("w"), h.alias("h"), F.round(w * h, 1).alias("area"), F.round("score", 3).alias("score"))


COCO_ANNOTATIONS = with_sql(DETECTIONS, _STATUS) + """
SELECT CAST(row_number() OVER (ORDER BY commit_id, det_id) AS BIGINT) AS id, commit_id AS image_id, category_id, round(x0, 1) AS x, round(y0, 1) AS y, round(x1 - x0, 1) AS w, round(y1 - y0, 1) AS h,
  round(round(x1 - x0, 1) * round(y1 - y0, 1), 1) AS area, round(score, 3) AS score
FROM statused JOIN (SELECT cls, CAST(row_number() OVER (ORDER BY cls) AS BIGINT) AS category_id FROM (SELECT DISTINCT cls FROM statused WHERE score >= 0.97)) USING (cls) WHERE score >= 0.97"""


def summary_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per walk a JSON object of status counts with sorted keys, as the summary document has it (K1, A4)."""
    n = _statused(spark, sf_dir).groupBy("walk_id", "status").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("status", "n")))
    return n.groupBy("walk_id").agg(F.to_json(F.map_from_entries(entries)).alias("detections"))


SUMMARY_MAPS = with_sql(DETECTIONS, _STATUS) + """
SELECT walk_id, '{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}' AS detections FROM (SELECT walk_id, status, count(*) AS n FROM statused GROUP BY ALL) GROUP BY walk_id"""


def grid_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter grid crossed with walks: the mean of each walk's ratio, not the ratio of sums."""
    s = _statused(spark, sf_dir)
    each = lambda *values: F.explode(F.array(*map(F.lit, values)))
    run = s.select("walk_id", "status", "score", each("inner", "band").alias("kind")).select("*", each(0.92, 0.95, 0.98).alias("threshold")).groupBy("walk_id", "kind", "threshold").agg((100.0 * F.count_if((F.col("status") == F.col("kind")) & (F.col("score") >= F.col("threshold"))) / F.count("*")).alias("p"))
    return run.groupBy("kind").pivot("threshold", [0.92, 0.95, 0.98]).agg(F.round(F.avg("p"), 6)).toDF("kind", "t92", "t95", "t98")


GRID_MEANS = with_sql(DETECTIONS, _STATUS) + """
SELECT kind, round(avg(p) FILTER (WHERE th = 0.92), 6) AS t92, round(avg(p) FILTER (WHERE th = 0.95), 6) AS t95, round(avg(p) FILTER (WHERE th = 0.98), 6) AS t98
FROM (SELECT walk_id, kind, th, 100.0::DOUBLE * count(*) FILTER (WHERE status = kind AND score >= th) / count(*) AS p
  FROM statused, (VALUES ('inner'), ('band')) k(kind), (VALUES (0.92::DOUBLE), (0.95), (0.98)) g(th) GROUP BY ALL) GROUP BY kind"""


_NAMES = (
    "stock_lines live_list zero_lines bay_rollup export_sheet catalogue_duplicates truth_literal suggestions session_state lifecycle_errors review_blockers open_cases quality_gates detector_metrics "
    "flywheel_labels lifted_depth look_alike_groups op_inventory coco_annotations summary_maps grid_means"
).split()
QUERIES = {f"q{i + 46}_{n}": globals()[n] for i, n in enumerate(_NAMES)}
ORACLE_SQL = {f"q{i + 46}_{n}": globals()[n.upper()] for i, n in enumerate(_NAMES)}
