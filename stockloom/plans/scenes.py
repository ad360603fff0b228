"""Queries on how views lie to each other, on what was taught before, and on streams that are late or limited; each with its SQL for DuckDB but for those marked *."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.functions import geometry as g
from stockloom.operators import counting, detectors, index, ledger, registration
from stockloom.operators.detections import knn
from stockloom.plans.detections import _LINKS_SQL, BAND, HEIGHT, WIDTH, _links
from stockloom.plans.durable import fresh_path, staged
from stockloom.sources import workbooks
from stockloom.sources.adapters import COMMITS, DETECTIONS, commits, detections, sku, with_sql
from stockloom.sources.tables import table
from stockloom.streaming import triggers

# -- how views lie to each other --------------------------------------------------------------------------------------------

_DX, _DY = "(({a} * 37) % 161 - ({b} * 37) % 161) * 0.5::DOUBLE", "(({a} * 13) % 121 - ({b} * 13) % 121) * 0.4::DOUBLE"
_SKEW, _DEPTH = "(({a} % 3) - 1) * 0.02::DOUBLE", "({a} % 4) * 0.0002::DOUBLE"


def view_transform(ka: Column, kb: Column) -> Column:
    """The transform of view a into view b: each has a place on a wall, from its key; a little skewed and seen from one side."""
    dx, dy = ((ka * 37) % 161 - (kb * 37) % 161) * 0.5, ((ka * 13) % 121 - (kb * 13) % 121) * 0.4
    skew, depth = ((ka % 3) - 1) * 0.02, (ka % 4) * 0.0002
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(one, skew, dx, -skew, one, dy, depth, zero, one)


def _warped(h: Column, band: float = 0.0) -> list[tuple[Column, Column]]:
    """The corners of a view, or of its inner frame, under a transform."""
    corners = [(band, band), (WIDTH - band, band), (WIDTH - band, HEIGHT - band), (band, HEIGHT - band)]
    return [g.warp_point(h, F.lit(x), F.lit(y)) for x, y in corners]


_CORNERS = lambda band: [(band, band), (WIDTH - band, band), (WIDTH - band, HEIGHT - band), (band, HEIGHT - band)]


def _warped_sql(a: str, b: str, band: float = 0.0) -> list[tuple[str, str]]:
    dx, dy, skew, depth = (t.format(a=a, b=b) for t in (_DX, _DY, _SKEW, _DEPTH))
    return [(f"(({x}::DOUBLE + {skew} * {y}::DOUBLE + {dx}) / ({depth} * {x}::DOUBLE + 1.0::DOUBLE))", f"((-({skew}) * {x}::DOUBLE + {y}::DOUBLE + {dy}) / ({depth} * {x}::DOUBLE + 1.0::DOUBLE))") for x, y in _CORNERS(band)]


def _polygon_sql(points: list[tuple[str, str]]) -> str:
    return "[" + ", ".join(f"{{'x': {x}::DOUBLE, 'y': {y}::DOUBLE}}" for x, y in points) + "]"


def _clip_steps(source: str, start: str, quad: str, name: str) -> list[str]:
    """Tables ``name1`` to ``name4``: the polygon ``start`` of ``source`` cut by one side of the list ``quad`` after the other. Quads go round to the left."""
    steps, before, poly = [], source, start
    for k in range(4):
        a, b = f"{quad}[{k + 1}]", f"{quad}[{(k + 1) % 4 + 1}]"
        side = lambda p: f"(({b}.x - {a}.x) * ({p}.y - {a}.y) - ({b}.y - {a}.y) * ({p}.x - {a}.x))"  # noqa: B023, E731
        p, q = f"{poly}[i]", f"{poly}[CASE WHEN i = 1 THEN len({poly}) ELSE i - 1 END]"
        share = f"({side(q)} / ({side(q)} - {side(p)}))"
        cross = f"CASE WHEN ({side(p)} >= 0) <> ({side(q)} >= 0) THEN [{{'x': {q}.x + {share} * ({p}.x - {q}.x), 'y': {q}.y + {share} * ({p}.y - {q}.y)}}] ELSE [] END"
        steps.append(f"{name}{k + 1} AS (SELECT *, flatten(list_transform(range(1, len({poly}) + 1), lambda i: list_concat({cross}, CASE WHEN {side(p)} >= 0 THEN [{p}] ELSE [] END))) AS {name}_p{k + 1} FROM {before})")
        before, poly = f"{name}{k + 1}", f"{name}_p{k + 1}"
    return steps


def _area_sql(poly: str) -> str:
    n = f"CASE WHEN i < len({poly}) THEN i + 1 ELSE 1 END"
    return f"abs(coalesce(list_sum(list_transform(range(1, len({poly}) + 1), lambda i: {poly}[i].x * {poly}[{n}].y - {poly}[{n}].x * {poly}[i].y)), 0)) / 2"


_VIEW = _polygon_sql([(str(x), str(y)) for x, y in _CORNERS(0.0)])


def view_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a view each linked earlier view covers: the area of its warped corners inside the view."""
    lk = _links(spark, sf_dir)
    view = [(F.lit(x), F.lit(y)) for x, y in _CORNERS(0.0)]
    shared = g.convex_overlap(_warped(view_transform(F.col("ka"), F.col("kb"))), view)
    return lk.select("walk_id", "a", "b", F.round(shared / (WIDTH * HEIGHT), 6).alias("share"))


VIEW_OVERLAPS = with_sql(COMMITS, _LINKS_SQL, f"quads AS (SELECT walk_id, a, b, {_polygon_sql(_warped_sql('ka', 'kb'))} AS quad, {_VIEW} AS view_ FROM links)", *_clip_steps("quads", "quad", "view_", "cut")) + f"""
SELECT walk_id, a, b, round({_area_sql('cut_p4')} / {WIDTH * HEIGHT}::DOUBLE, 6) AS share FROM cut4"""


def zone_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a commit whose centre lies in the inner frame of a linked earlier view, moved by the link (U7): they are asked about."""
    c = commits(spark, sf_dir).select("commit_id", "n")
    d = detections(spark, sf_dir).join(c, "commit_id").select("walk_id", F.struct("n", "det_id").alias("det_id"), "n", *g.box())
    lk = _links(spark, sf_dir).where("b - a <= 6").select("walk_id", F.col("b").alias("n"), view_transform(F.col("ka"), F.col("kb")).alias("h"))
    keyed = lambda df: df.withColumn("walk_id", F.struct("walk_id", "n"))  # noqa: E731  # one commit of a walk at a time
    got = counting.frames_over(keyed(d), keyed(lk), WIDTH, HEIGHT, BAND)
    return got.select(F.col("walk_id.walk_id").alias("walk_id"), F.col("det_id.n").alias("n"), F.col("det_id.det_id").alias("det_id"))


def _in_quad_sql(quad: list[tuple[str, str]]) -> str:
    sides = [f"(({bx} - {ax}) * (cy - {ay}) - ({by} - {ay}) * (cx - {ax}))" for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1], strict=True)]
    return f"(({' AND '.join(s + ' >= 0' for s in sides)}) OR ({' AND '.join(s + ' <= 0' for s in sides)}))"


_NAMED = [(f"q{k}x", f"q{k}y") for k in range(4)]
ZONE_QUESTIONS = with_sql(DETECTIONS, COMMITS, _LINKS_SQL, "quads AS (SELECT walk_id, b, " + ", ".join(f"{x} AS q{k}x, {y} AS q{k}y" for k, (x, y) in enumerate(_warped_sql("ka", "kb", BAND))) + " FROM links WHERE b - a <= 6)") + f"""
SELECT d.walk_id, c.n, d.det_id FROM (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM detections) d JOIN commits c USING (commit_id)
WHERE EXISTS (SELECT 1 FROM quads z WHERE z.walk_id = d.walk_id AND z.b = c.n AND {_in_quad_sql(_NAMED)})"""

# -- proposals --------------------------------------------------------------------------------------------------------------

DESCRIPTORS, BITS, MORE, OFTEN = 4, 6, 4, 1000


def _descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each keyframe's descriptors: a few vectors of ``embeddings``, picked by its key."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding").alias("v"))
    many = max(v.count(), 1)
    own = commits(spark, sf_dir).select("walk_id", "n", "commit_id", F.explode(F.sequence(F.lit(0), F.lit(DESCRIPTORS - 1))).alias("j"))
    return own.withColumn("vec", (F.col("commit_id") * (7 + 2 * F.col("j")) + 31 * F.col("j")) % many).join(v, "vec").select("walk_id", "n", "v")


def proposed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of keyframes worth registering: those that share visual words, from an inverted index."""
    postings = registration.posting_words(_descriptors(spark, sf_dir), BITS, MORE, OFTEN)
    return registration.proposed_pairs(postings)


WORDS = f"""words AS (SELECT DISTINCT c.walk_id, c.n, list_reduce(list_transform(e.embedding[1:{BITS}], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END), lambda a, x: a * 2 + x) AS word
  FROM (SELECT *, unnest(range({DESCRIPTORS})) AS j FROM commits) c, (SELECT count(*) AS many FROM embeddings) m JOIN embeddings e ON e.vec_id = (c.commit_id * (7 + 2 * c.j) + 31 * c.j) % m.many)"""
PAIRS = "SELECT x.walk_id, x.n AS a, y.n AS b, count(*) AS shared FROM words x JOIN words y ON x.walk_id = y.walk_id AND x.word = y.word AND x.n < y.n GROUP BY ALL"
PROPOSED_PAIRS = with_sql(COMMITS, WORDS) + PAIRS

LISTS, RECALL = 16, 0.97


def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest rows of every row with an id divisible by 20, through an inverted-file index (*: recall is tested against the exact search)."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    centres = index.fit_centres(v, LISTS)
    return index.knn_indexed(v.where("id % 20 = 0"), v, centres, 3, index.calibrated_probes(v, centres, 3, RECALL)).select("q", "rank", "g")


# -- what was taught before -------------------------------------------------------------------------------------------------

SESSION, TRUST = 50, 0.2


def taught_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for the groups of a session from examples that were confirmed before it began (X3, X5): as-of, then the nearest.

    Rows of ``embeddings`` are groups in the order of their sessions. The confirmed ones are appended as examples, a folder for each
    session; a group whose id is divisible by 20 asks, and takes the name of the most similar earlier example, if it is near enough.
    """
    path = fresh_path(spark, "examples")
    groups = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("group_id"), F.floor(F.col("vec_id") / SESSION).alias("session"), F.col("label").cast("long").alias("code"), F.col("embedding").alias("v"))
    ledger.teach(groups.where("group_id % 3 <> 0"), path)
    examples = ledger.examples(spark, path)
    asking = groups.where("group_id % 20 = 0").select(F.col("group_id").alias("id"), "v", F.col("session").alias("at"))
    taught = examples.select(F.col("group_id").alias("id"), "v", F.col("session").alias("at"), "code")
    near = index.knn_indexed(asking, taught, index.fit_centres(taught, LISTS), 1, LISTS).where(F.col("sim") >= TRUST)
    named = near.join(taught.select(F.col("id").alias("g"), "code"), "g").select(F.col("q").alias("group_id"), F.col("g").alias("example"), F.col("code").alias("suggested"))
    return asking.select(F.col("id").alias("group_id"), F.col("at").alias("session")).join(named, "group_id", "left")


TAUGHT_SUGGESTIONS = f"""
SELECT q.vec_id AS group_id, q.vec_id // {SESSION} AS session, arg_max(e.vec_id, (s, -e.vec_id)) FILTER (WHERE s >= {TRUST}) AS example, arg_max(e.label::BIGINT, (s, -e.vec_id)) FILTER (WHERE s >= {TRUST}) AS suggested
FROM embeddings q LEFT JOIN embeddings e ON e.vec_id // {SESSION} < q.vec_id // {SESSION} AND e.vec_id % 3 <> 0,
LATERAL (SELECT round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS s)
WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id"""


SIZES = (1, 3, 5)


def gallery_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-1 and top-3 accuracy of suggestions by how many examples of each name there are (A27): the first one, three or five of it."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    first = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    examples = staged(v.where("id % 20 <> 0").withColumn("r", first).where(F.col("r") <= max(SIZES)), "gallery")
    asking, out = v.where("id % 20 = 0"), None
    for size in SIZES:
        near = knn(asking, examples.where(F.col("r") <= size), 3)
        named = near.join(examples.select(F.col("id").alias("g"), F.col("label").alias("guess")), "g").join(asking.select(F.col("id").alias("q"), "label"), "q")
        hit = F.col("label") == F.col("guess")
        per = named.groupBy("q").agg(F.max((hit & (F.col("rank") == 1)).cast("int")).alias("one"), F.max(hit.cast("int")).alias("three"))
        got = per.agg(F.count("*").alias("queries"), F.sum("one").alias("top1"), F.sum("three").alias("top3")).withColumn("examples", F.lit(size))
        out = got if out is None else out.unionByName(got)
    return out.select("examples", "queries", "top1", "top3")


GALLERY_ACCURACY = f"""WITH ex AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings WHERE vec_id % 20 <> 0),
near AS (SELECT k.examples, q.vec_id AS q, q.label, e.label AS guess, row_number() OVER (PARTITION BY k.examples, q.vec_id ORDER BY s DESC, e.vec_id) AS rank
  FROM (VALUES {', '.join(f'({n})' for n in SIZES)}) k(examples), (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, ex e,
  LATERAL (SELECT round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS s) WHERE e.r <= k.examples)
SELECT examples, count(*) AS queries, CAST(sum(one) AS BIGINT) AS top1, CAST(sum(three) AS BIGINT) AS top3
FROM (SELECT examples, q, max(CASE WHEN rank = 1 AND label = guess THEN 1 ELSE 0 END) AS one, max(CASE WHEN label = guess THEN 1 ELSE 0 END) AS three FROM near WHERE rank <= 3 GROUP BY ALL) GROUP BY examples"""


def median_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median box of each class and how far its centres lie from their commit's median centre, by axis."""
    cx, cy = g.centre(g.box())
    d = detections(spark, sf_dir).select("commit_id", "cls", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), cx.alias("cx"), cy.alias("cy"))
    mid = d.groupBy("commit_id").agg(F.median("cx").alias("mx"), F.median("cy").alias("my"))
    moved = d.join(mid, "commit_id")
    return moved.groupBy("cls").agg(*(F.round(F.median(c), 6).alias(n) for c, n in ((F.col("w"), "wide"), (F.col("h"), "tall"), (F.col("cx") - F.col("mx"), "dx"), (F.col("cy") - F.col("my"), "dy"))))


MEDIAN_SIZES = with_sql(DETECTIONS, "c AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM detections)", "m AS (SELECT commit_id, median(cx) AS mx, median(cy) AS my FROM c GROUP BY commit_id)") + """
SELECT cls, round(median(x1 - x0), 6) AS wide, round(median(y1 - y0), 6) AS tall, round(median(cx - mx), 6) AS dx, round(median(cy - my), 6) AS dy FROM c JOIN m USING (commit_id) GROUP BY cls"""


# -- streams that are late or limited ---------------------------------------------------------------------------------------

SLICES, DELAY_HOURS = 4, 1


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which some rows come a slice or more too late and some twice: what is kept of each kind, and what is dropped as late or repeated."""
    base = fresh_path(spark, "late")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    own = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(low))) * SLICES / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1)), F.lit(SLICES - 1)) if low else F.lit(0)
    feed = e.withColumn("slice", F.least(own + F.when(F.col("event_id") % 10 == 0, F.col("event_id") % 3).otherwise(0), F.lit(SLICES - 1)).cast("int"))
    feed = staged(feed.unionByName(feed.where("event_id % 7 = 0")), "feed")
    for i in range(SLICES):
        feed.where(F.col("slice") == i).drop("slice").write.mode("append").parquet(f"{base}/in")
        src = spark.readStream.schema(feed.drop("slice").schema).parquet(f"{base}/in")
        q = triggers.first_in_time(src, "event_id", f"{DELAY_HOURS} hour").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    kept = spark.read.schema("event_id long, ts timestamp, kind string").parquet(f"{base}/out").select("event_id")
    return triggers.dropped(feed, kept, "event_id").groupBy("kind").agg(F.sum("fed").alias("fed"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("late"), F.sum(F.when(F.col("kept"), F.col("fed") - 1).otherwise(0)).alias("repeated"))


LATE_ROWS = f"""WITH bounds AS (SELECT min(ts) AS low, max(ts) AS high FROM events),
feed AS (SELECT event_id, ts, event_type AS kind, least(least((epoch_us(ts) - epoch_us(low)) * {SLICES} // (epoch_us(high) - epoch_us(low) + 1), {SLICES - 1}) + CASE WHEN event_id % 10 = 0 THEN event_id % 3 ELSE 0 END, {SLICES - 1}) AS slice,
  CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS fed FROM events, bounds),
marks AS (SELECT slice + 1 AS slice, max(max(epoch_ms(ts))) OVER (ORDER BY slice) - {DELAY_HOURS * 3_600_000} AS mark FROM feed GROUP BY slice),
seen AS (SELECT f.*, m.mark IS NULL OR epoch_us(ts) > m.mark * 1000 AS kept FROM feed f LEFT JOIN marks m USING (slice))
SELECT kind, CAST(sum(fed) AS BIGINT) AS fed, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS late, CAST(sum(CASE WHEN kept THEN fed - 1 ELSE 0 END) AS BIGINT) AS repeated FROM seen GROUP BY kind"""


def limited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind from a stream that takes two files a batch, however many are waiting."""
    base = fresh_path(spark, "limited")
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    e.repartition(7, "event_id").write.parquet(f"{base}/in")
    src = triggers.limited(spark, e.schema, f"{base}/in", files=2)
    q = src.groupBy("kind").agg(F.count("*").alias("events")).writeStream.outputMode("complete").foreachBatch(triggers.whole_result(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return triggers.last_result(spark, f"{base}/out", "kind string, events long")


LIMITED_COUNTS = "SELECT event_type AS kind, count(*) AS events FROM events GROUP BY 1"

# -- by name in SQL, by file, by consensus ----------------------------------------------------------------------------------


def detectors_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown and counted boxes by detector and class, with the detectors called by name from SQL (F1, F2)."""
    boxes = staged(detections(spark, sf_dir).select("cls", *g.box(), ((F.col("score") - 0.9) * 10).alias("score")), "boxes")
    detectors.register(spark, boxes.schema)
    boxes.createOrReplaceTempView("boxes_of_views")
    each = " UNION ALL ".join(f"SELECT '{n}' AS detector, cls, counted FROM detector(TABLE(SELECT cls, x0, y0, x1, y1, score FROM boxes_of_views), '{n}')" for n in detectors.names())
    return spark.sql(f"SELECT detector, cls, count(*) AS shown, count_if(counted) AS counted FROM ({each}) GROUP BY detector, cls")


_EDGE = "(least(abs(x0 - 64), abs(x1 - 64), abs(y0 - 48), abs(y1 - 48)) <= 2)"
DETECTORS_IN_SQL = with_sql(DETECTIONS) + f"""
SELECT detector, cls, count(*) AS shown, count(*) FILTER (WHERE s >= hi) AS counted
FROM (SELECT cls, (score - 0.9) * 10 AS s, NOT {_EDGE} AS inside FROM detections), (VALUES {', '.join(f"('{n}', {lo}::DOUBLE, {hi}::DOUBLE, {str(tiled).lower()})" for n, (lo, hi, tiled) in detectors.THRESHOLDS.items())}) t(detector, lo, hi, tiled)
WHERE s >= lo AND (NOT tiled OR inside) GROUP BY detector, cls"""


def imported_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue written to workbooks by all tasks and imported again, with our names for its columns and repeated names marked (SC10)."""
    path = fresh_path(spark, "workbooks")
    theirs = sku(spark, sf_dir).select(F.col("code").alias("Item number"), F.col("name").alias("Item"), F.col("brand").alias("Maker"), F.col("units_per_case").alias("Per case"))
    workbooks.write_workbooks(theirs, path).agg(F.sum("rows")).first()
    got = workbooks.read_workbooks(spark, path, {"Item number": "code", "Item": "name", "Maker": "brand", "Per case": "units_per_case"})
    again = got.groupBy("name").agg(F.count("*").alias("times"))
    return got.join(again, "name", "left").select("code", "name", "brand", "units_per_case", (F.coalesce("times", F.lit(1)) > 1).alias("repeated"))


IMPORTED_CATALOGUE = "SELECT p_partkey::VARCHAR AS code, trim(p_name) AS name, p_brand AS brand, p_size::VARCHAR AS units_per_case, count(*) OVER (PARTITION BY p_name) > 1 AS repeated FROM part"


def zone_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity on which most matches of each view agree, of which every fourth is wrong.

    The points of a view are its boxes' corners; the others are their images under a turn and shift from the key, or, for each box whose
    id is divisible by four, far from there. The numbers have to come out as they went in.
    """
    c, d = F.col("commit_id"), detections(spark, sf_dir)
    a, b = 1 + (c % 7) * 0.02, ((c % 5) - 2) * 0.03
    spots = d.select("commit_id", "det_id", F.posexplode(F.array(F.struct(F.col("x0").alias("px"), F.col("y0").alias("py")), F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")))).alias("k", "p"))
    px, py, wrong = F.col("p.px"), F.col("p.py"), F.when(F.col("det_id") % 4 == 0, 37.0 + 11 * F.col("det_id") + 5 * F.col("k")).otherwise(0.0)
    m = spots.select("commit_id", (F.col("det_id") * 2 + F.col("k")).alias("id"), px.alias("px"), py.alias("py"), (a * px - b * py + 5 + c % 11 + wrong).alias("qx"), (b * px + a * py - 3 - c % 13 - wrong).alias("qy"))
    fits = registration.robust_fits(m, ["commit_id"], 0.5)
    return fits.where("agree >= 6").select("commit_id", "matches", "agree", *(F.round(k, 6).alias(k) for k in ("a", "b", "x", "y")))


ZONE_FITS = with_sql(DETECTIONS) + """
SELECT commit_id, 2 * count(*) AS matches, 2 * count(*) FILTER (WHERE det_id % 4 <> 0) AS agree, round(1 + (commit_id % 7) * 0.02::DOUBLE, 6) AS a, round(((commit_id % 5) - 2) * 0.03::DOUBLE, 6) AS b,
  5.0::DOUBLE + commit_id % 11 AS x, -3.0::DOUBLE - commit_id % 13 AS y FROM detections GROUP BY commit_id HAVING count(*) FILTER (WHERE det_id % 4 <> 0) >= 3"""

_NAMES = "view_overlaps zone_questions proposed_pairs knn_indexed taught_suggestions late_rows limited_counts detectors_in_sql imported_catalogue zone_fits".split()
QUERIES = {f"q{i + 99}_{n}": globals()[n] for i, n in enumerate(_NAMES)}
QUERIES |= {"q110_gallery_accuracy": gallery_accuracy, "q111_median_sizes": median_sizes}
ORACLE_SQL = {k: globals()[f.__name__.upper()] for k, f in QUERIES.items() if f.__name__.upper() in globals()}
