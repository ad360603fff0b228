"""Joins and cleaning of detections. Self-joins are keyed by commit; spatial joins get a grid cell as a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import geometry as g
from stockloom.plans.durable import staged
from stockloom.plans.groups import dealt, whole_groups

BOX = ("x0", "y0", "x1", "y1")
KNN_BLOCK, KNN_SLICE = 2048, 256
CELL = 3.0


def prefixed(df: DataFrame, p: str, *cols: str) -> DataFrame:
    return df.select(*(F.col(c).alias(p + c) for c in (cols or df.columns)))


def pairs(dets: DataFrame, key: str = "commit_id") -> DataFrame:
    """Every ordered pair of different detections of one commit, columns prefixed a_ and b_."""
    a, b = prefixed(dets, "a_"), prefixed(dets, "b_")
    return a.join(b, (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col("a_det_id") != F.col("b_det_id")))


def overlapping(dets: DataFrame, least: float) -> DataFrame:
    """Pairs a < b of one commit with an IoU of ``least`` or more."""
    return pairs(dets).where("a_det_id < b_det_id").withColumn("iou", g.iou(g.box("a_"), g.box("b_"))).where(F.col("iou") >= least)


def row_boxes(dets: DataFrame) -> DataFrame:
    """Boxes around a row of others of their class: two or more smaller ones (under 0.6 of its area, centre strictly
    inside) that fill over half of it."""
    p = pairs(dets).where("a_cls = b_cls")
    cx, cy = g.centre(g.box("b_"))
    outer, inner = g.box("a_"), g.area(g.box("b_"))
    inside = (cx > outer[0]) & (cx < outer[2]) & (cy > outer[1]) & (cy < outer[3]) & (inner < 0.6 * g.area(outer))
    got = p.where(inside).groupBy("a_commit_id", "a_det_id", *(f"a_{c}" for c in BOX)).agg(F.count("*").alias("n"), F.sum(inner).alias("filled"))
    return got.where((F.col("n") >= 2) & (F.col("filled") > 0.5 * g.area(outer))).select(F.col("a_commit_id").alias("commit_id"), F.col("a_det_id").alias("det_id"))


def part_boxes(dets: DataFrame) -> DataFrame:
    """Boxes of which a larger one of the class, scored at least as high, covers over 0.8."""
    p = pairs(dets).where((F.col("a_cls") == F.col("b_cls")) & (F.col("b_score") >= F.col("a_score")))
    a, b = g.box("a_"), g.box("b_")
    return p.where((g.area(b) > g.area(a)) & (g.coverage(a, b) > 0.8)).select(F.col("a_commit_id").alias("commit_id"), F.col("a_det_id").alias("det_id")).distinct()


def without(dets: DataFrame, drop: DataFrame) -> DataFrame:
    return dets.join(drop, ["commit_id", "det_id"], "left_anti")


def clean(dets: DataFrame, iou: float = 0.5) -> DataFrame:
    """Greedy suppression, then row boxes judged on its survivors, then part boxes judged on theirs.

    Survivors are written after either step: each of the next joins reads them three times.
    """
    from stockloom.operators.folds import suppress

    kept = staged(suppress(dets, iou), "suppressed")
    kept = staged(without(kept, row_boxes(kept)), "rows")
    return without(kept, part_boxes(kept))


def _cell(x: str, reach: float) -> Column:
    """The grid cell of a place on one axis. Cells are three reaches wide, so that an item goes to 2.8 cells on average, not to nine."""
    return F.floor(F.col(x) / (CELL * reach))


def _cells(x: str, reach: float) -> Column:
    """A row for each cell that lies within reach of an item on one axis; a trifle more, for rounding."""
    wide = reach * (1 + 1e-6)
    return F.explode(F.sequence(F.floor((F.col(x) - wide) / (CELL * reach)), F.floor((F.col(x) + wide) / (CELL * reach))))


def gated_new(dets: DataFrame, items: DataFrame, gate: float, weight: tuple[float, float], keys: list[str]) -> DataFrame:
    """Detections without a counted item of their class within a weighted distance: an anti join on grid cells.

    Items go to the cells that the gate around them touches; detections look in one.
    """
    wide = [gate / w for w in weight]
    cx, cy = g.centre(g.box())
    at = lambda df: df.withColumn("_x", cx).withColumn("_y", cy).withColumn("_i", _cell("_x", wide[0])).withColumn("_j", _cell("_y", wide[1]))
    near = items.select(*(F.col(k).alias(f"_{k}") for k in keys), cx.alias("_ix"), cy.alias("_iy"))
    near = near.select("*", _cells("_ix", wide[0]).alias("_ci")).select("*", _cells("_iy", wide[1]).alias("_cj"))
    dist = ((F.col("_x") - F.col("_ix")) * weight[0]) ** 2 + ((F.col("_y") - F.col("_iy")) * weight[1]) ** 2
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    on = (F.col("_i") == F.col("_ci")) & (F.col("_j") == F.col("_cj")) & (dist <= gate * gate)
    for s in same:
        on = on & s
    return at(dets).join(near, on, "left_anti").drop("_x", "_y", "_i", "_j")


def near_items(points: DataFrame, items: DataFrame, keys: list[str], x: str, y: str, reach: float) -> DataFrame:
    """Points with the items of equal ``keys`` whose reach touches their grid cell: all within ``reach`` on either axis, and some more.

    items: keys, ix, iy and others; names of points and items differ but for the keys.
    """
    spread = items.select("*", _cells("ix", reach).alias("_i")).select("*", _cells("iy", reach).alias("_j"))
    return points.withColumn("_i", _cell(x, reach)).withColumn("_j", _cell(y, reach)).join(spread, [*keys, "_i", "_j"]).drop("_i", "_j")


def offset_candidates(dets: DataFrame, items: DataFrame, keys: list[str], limit: float, quantum: float) -> DataFrame:
    """Distinct quantised offsets that move some detection of a commit onto an item of its class (and no offset).

    dets: keys, commit_id, cls, cx, cy; items: keys, cls, ix, iy. Joined on grid cells as wide as ``limit``.
    """
    d = near_items(dets, items, [*keys, "cls"], "cx", "cy", limit).withColumn("dx", F.col("ix") - F.col("cx")).withColumn("dy", F.col("iy") - F.col("cy"))
    near = d.where((F.abs("dx") <= limit) & (F.abs("dy") <= limit))
    q = near.select(*keys, *((F.round(F.col(c) / quantum) * quantum).alias(c) for c in ("dx", "dy")))
    return q.unionByName(dets.select(*keys).distinct().select(*keys, F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))).distinct()


def offset_votes(dets: DataFrame, items: DataFrame, cands: DataFrame, keys: list[str], gate: float, limit: float) -> DataFrame:
    """Votes of each candidate: detections that it moves to within ``gate`` of an item of their class, 1 if the nearest such item
    has their product and 0.5 if not.

    No candidate moves further than ``limit`` on an axis, so only pairs within that and the gate meet, and these meet the candidates
    near their difference: no detection is multiplied by the candidates of its walk.
    """
    pairs = near_items(dets, items, [*keys, "cls"], "cx", "cy", limit + gate).withColumnsRenamed({"ix": "_tx", "iy": "_ty"})
    pairs = pairs.withColumn("ix", F.col("_tx") - F.col("cx")).withColumn("iy", F.col("_ty") - F.col("cy")).where((F.abs("ix") <= (limit + gate) * (1 + 1e-6)) & (F.abs("iy") <= (limit + gate) * (1 + 1e-6)))
    hit = near_items(cands, pairs, keys, "dx", "dy", gate).withColumn("dist", F.hypot(F.col("cx") + F.col("dx") - F.col("_tx"), F.col("cy") + F.col("dy") - F.col("_ty"))).where(F.col("dist") <= gate)
    best = hit.groupBy(*keys, "dx", "dy", "det_id").agg(F.min_by(F.col("sku") == F.col("item_sku"), F.struct("dist", F.col("sku") != F.col("item_sku"))).alias("agree"))
    return best.groupBy(*keys, "dx", "dy").agg(F.sum(F.when(F.col("agree"), 1.0).otherwise(0.5)).alias("votes"))


def best_offset(votes: DataFrame, sizes: DataFrame, keys: list[str], tie: float) -> DataFrame:
    """The winning offset: within ``tie`` of the most votes the shortest; 0 if support is under 3 or a quarter of the detections."""
    top = F.max("votes").over(Window.partitionBy(*keys))
    near = votes.withColumn("_top", top).where(F.col("votes") >= F.col("_top") - tie)
    won = near.groupBy(*keys).agg(F.min(F.struct(F.hypot("dx", "dy").alias("len"), "dx", "dy")).alias("o"), F.max("_top").alias("support"))
    out = sizes.join(won, keys, "left")
    ok = F.coalesce(F.col("support") >= F.greatest(F.lit(3.0), 0.25 * F.col("n")), F.lit(False))
    return out.select(*keys, F.when(ok, F.col("o.dx")).otherwise(0.0).alias("dx"), F.when(ok, F.col("o.dy")).otherwise(0.0).alias("dy"), F.coalesce("support", F.lit(0.0)).alias("support"))


def knn(queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """``(q, rank, g, sim)``: the ``k`` most similar of the gallery by cosine, ties by id; vectors ``v`` have unit length.

    Exact: queries and gallery, which holds the queries' rows too, are dealt into blocks of about ``KNN_BLOCK``; each pair of
    blocks meets in one task, ``KNN_SLICE`` queries in a matrix product, of which a query keeps ``k``; what the pairs gave is merged by rank. A row is not its own neighbour.
    """
    many = {n: max(1, -(-df.count() // KNN_BLOCK)) for n, df in (("q", queries), ("g", gallery))}
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(many[n])).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(many[n] - 1)))
    vec = F.col("v").cast("array<double>").alias("v")
    sides = queries.select("id", vec, block("q").alias("qb"), F.lit(0).alias("side"), every("g").alias("gb"))
    sides = sides.unionByName(gallery.select("id", vec, block("g").alias("gb"), F.lit(1).alias("side"), every("q").alias("qb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in whole_groups(batches, ["qb", "gb"]):
            ids, side = b["id"].to_numpy(), b["side"].to_numpy()
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                v = b["v"].slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1)
                asking, other = np.flatnonzero(side[i:j] == 0), np.flatnonzero(side[i:j] == 1)
                if not len(asking) or not len(other):
                    continue
                other = other[np.argsort(ids[i:j][other], kind="stable")]
                for lo in range(0, len(asking), KNN_SLICE):
                    own = asking[lo : lo + KNN_SLICE]
                    sim = np.round(v[own] @ v[other].T, 9)
                    sim[ids[i:j][own][:, None] == ids[i:j][other][None]] = -np.inf
                    best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    got, row = np.take_along_axis(sim, best, 1), np.repeat(np.arange(len(own)), best.shape[1])
                    live = np.isfinite(got.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][own][row][live]), pa.array(ids[i:j][other][best.ravel()][live]), pa.array(got.ravel()[live])], ["q", "g", "sim"])

    best = dealt(sides, ["qb", "gb"]).mapInArrow(run, "q long, g long, sim double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "g"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("q", "rank", "g", "sim")


def in_any_zone(dets: DataFrame, zones: DataFrame, keys: list[str], cell: float = 16.0) -> DataFrame:
    """Detections whose centre lies in a zone of an earlier commit, by grid cells, of which a zone has all that it touches.

    Of the zones that cover a cell whole only the earliest counts: one row a cell answers for them all. Only detections that it
    does not answer for look at the zones whose border goes through their cell. zones: keys, zone_n, zx0, zy0, zx1, zy1.
    """
    cx, cy = g.centre(g.box())
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    z = zones.select(*keys, "zone_n", "zx0", "zy0", "zx1", "zy1", span("zx0", "zx1").alias("_i")).select("*", span("zy0", "zy1").alias("_j"))
    whole = (F.col("_i") * cell >= F.col("zx0")) & ((F.col("_i") + 1) * cell <= F.col("zx1")) & (F.col("_j") * cell >= F.col("zy0")) & ((F.col("_j") + 1) * cell <= F.col("zy1"))
    first = z.where(whole).groupBy(*keys, "_i", "_j").agg(F.min("zone_n").alias("_first"))
    d = dets.withColumn("_i", F.floor(cx / cell)).withColumn("_j", F.floor(cy / cell)).join(first, [*keys, "_i", "_j"], "left")
    known = F.coalesce(F.col("_first") < F.col("n"), F.lit(False))
    border = z.where(~whole).select(*(F.col(k).alias(f"_{k}") for k in (*keys, "_i", "_j")), "zone_n", "zx0", "zy0", "zx1", "zy1")
    on = (F.col("zone_n") < F.col("n")) & g.in_rect(cx, cy, (F.col("zx0"), F.col("zy0"), F.col("zx1"), F.col("zy1")))
    for k in (*keys, "_i", "_j"):
        on = on & (F.col(k) == F.col(f"_{k}"))
    return d.where(known).unionByName(d.where(~known).join(border, on, "left_semi")).select(dets.columns)


def view_items(items: DataFrame, views: DataFrame, cell: float) -> DataFrame:
    """Items inside views, by a range join on grid cells of width ``cell``: each item has one cell, a view all it touches."""
    ij = (F.floor(F.col("x") / cell), F.floor(F.col("y") / cell))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    v = views.select("*", span("vx0", "vx1").alias("_i")).select("*", span("vy0", "vy1").alias("_j"))
    i = items.withColumn("_i", ij[0]).withColumn("_j", ij[1])
    return i.join(v, ["_i", "_j"]).where(g.in_rect(F.col("x"), F.col("y"), (F.col("vx0"), F.col("vy0"), F.col("vx1"), F.col("vy1")))).drop("_i", "_j")


def best_sighting(sightings: DataFrame, links: DataFrame) -> DataFrame:
    """For each item and commit the linked earlier commit that saw it, with most inliers, later ones first among equals."""
    j = sightings.join(links, sightings["seen_in"] == links["a"]).select("item_id", links["b"].alias("commit_n"), "a", "inliers", *(c for c in sightings.columns if c not in ("item_id", "seen_in")))
    return j.groupBy("item_id", "commit_n").agg(F.max(F.struct("inliers", "a")).alias("m")).select("item_id", "commit_n", F.col("m.a").alias("via"), F.col("m.inliers").alias("inliers"))


def status(score: Column, b: g.Box, threshold: float, width: float, height: float, margin: float, band: float) -> Column:
    """``low`` before ``cut`` before the view status."""
    return F.when(score < threshold, "low").otherwise(g.view_status(b, F.lit(width), F.lit(height), F.lit(margin), F.lit(band)))


def box_hits(shown: DataFrame, truth: DataFrame, least: float) -> DataFrame:
    """``shown`` with ``hit``, 1 for a box that finds a truth of its view and class.

    Each box stands for the truth that it overlaps most, by ``least`` at least (the smallest id of equal ones); of the boxes for one
    truth the best scored finds it, the others are wrong. Both tables: commit_id, cls, det_id (unique in the view), x0, y0, x1, y1.
    """
    there = truth.select("commit_id", "cls", F.col("det_id").alias("_truth"), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    pairs = shown.select("commit_id", "cls", "det_id", "score", *g.box()).join(there, ["commit_id", "cls"]).withColumn("_iou", F.round(g.iou(g.box(), g.box("_")), 9)).where(F.col("_iou") >= least)
    best = pairs.groupBy("commit_id", "det_id", "score").agg(F.max(F.struct("_iou", (-F.col("_truth")).alias("m"))).alias("_b"))
    found = best.groupBy("commit_id", F.col("_b.m").alias("m")).agg(F.max(F.struct("score", (-F.col("det_id")).alias("d"))).alias("_f")).select("commit_id", (-F.col("_f.d")).alias("det_id"), F.lit(1).alias("_hit"))
    return shown.join(found, ["commit_id", "det_id"], "left").withColumn("hit", F.coalesce("_hit", F.lit(0)).cast("long")).drop("_hit")
