"""Counting a walk's views: which detections are new, which were counted before, and which need a question.

All walks go on together, one commit each in a superstep. Step ``n`` takes every walk's commit number ``n`` and is a plan over
what the steps before it have written:

- items come into the view along links: a step hands its items on to the commits that its own are linked with, once for each
  link, and a commit takes each item from the best-registered commit that saw it, so that no step reads what earlier ones have
  seen; with motion, items, counted zones and the zones' items are tables that move from step to step;
- a detection is asked about if a counted zone covers its centre: a join with the zones' moved frames;
- the detections and carried items of one commit meet in a small helper: pairs of a class vote for a common offset, and those within
  the gate after it fall into connected groups, of which the cheapest one-to-one matches are taken.

A step is written before the next one reads it. A group holds one commit of a walk, never a walk. Gates are inclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import geometry as g
from stockloom.functions import transforms
from stockloom.operators.detections import status as view_place
from stockloom.operators.folds import FORBIDDEN, assign
from stockloom.plans.durable import fresh_path, staged
from stockloom.plans.groups import dealt, whole_groups

REACH, QUANTUM, LEAST, SHARE = 0.5, 2.0, 3, 0.25
BOX = ("x0", "y0", "x1", "y1")
STATUS_SCHEMA = "walk_id long, n long, det_id long, cls string, status string"
_STEP = STATUS_SCHEMA + ", t double, x0 double, y0 double, x1 double, y1 double, item long"
_HANDED = "walk_id long, item long, cls string, x0 double, y0 double, x1 double, y1 double, inliers long, seen_in long, a int, b int"
TOGETHER = 1 << 18  # pairs and offsets at once
_HELD = 2**62  # what is tracked goes before what a link brings
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def _nine(values) -> Column:
    return F.array(*(v if isinstance(v, Column) else F.lit(float(v)) for v in values))


def zone_fit(many: Column, px: Column, py: Column, qx: Column, qy: Column, size: Column, along: Column, across: Column, dx: Column, dy: Column) -> Column:
    """How a zone has moved, from sums over its counted items: a least-squares similarity from four of them on if its scale is
    within (2/3, 1.5) and its rotation under 0.26 rad, else the median shift ``dx, dy``.

    px, py, qx, qy: mean centres then and now; size, along, across: sums of squares then, of products and of cross products.
    """
    a, b = along / F.when(size > 0, size), across / F.when(size > 0, size)
    zero, one = F.lit(0.0), F.lit(1.0)
    turned = F.array(a, -b, qx - (a * px - b * py), b, a, qy - (b * px + a * py), zero, zero, one)
    fits = (many >= 4) & F.coalesce(g.plausible_fit(a, b), F.lit(False))
    return F.when(fits, turned).otherwise(F.array(one, zero, dx, zero, one, dy, zero, zero, one))


def moved_zones(then: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, h)`` of each zone with an item in ``now``. then: keys, item, cx, cy; now: walk_id, item, ix, iy."""
    both = then.join(now, ["walk_id", "item"])
    mean = {f"m_{c}": F.avg(c).over(Window.partitionBy(*keys)) for c in ("cx", "cy", "ix", "iy")}
    px, py, qx, qy = (F.col(c) - F.col(f"m_{c}") for c in ("cx", "cy", "ix", "iy"))
    sums = F.sum(px * px + py * py).alias("size"), F.sum(px * qx + py * qy).alias("along"), F.sum(px * qy - py * qx).alias("across")
    d = both.withColumns(mean).groupBy(*keys).agg(F.count("*").alias("many"), *(F.first(c).alias(c) for c in mean), F.median(F.col("ix") - F.col("cx")).alias("dx"), F.median(F.col("iy") - F.col("cy")).alias("dy"), *sums)
    return d.select(*keys, zone_fit(F.col("many"), *map(F.col, mean), *map(F.col, ("size", "along", "across", "dx", "dy"))).alias("h"))


def _inner_frame(width: float, height: float, band: float) -> list[tuple[Column, Column]]:
    """The corners of a view's inner frame under its transform ``h``."""
    corners = [(band, band), (width - band, band), (width - band, height - band), (band, height - band)]
    return [g.warp_point(F.col("h"), F.lit(x), F.lit(y)) for x, y in corners]


def frames_over(dets: DataFrame, frames: DataFrame, width: float, height: float, band: float) -> DataFrame:
    """``(walk_id, det_id)`` of the detections whose centre lies in the inner frame of a view under one of its walk's transforms ``h``."""
    quad = [(F.col(f"_x{k}"), F.col(f"_y{k}")) for k in range(4)]
    cx, cy = g.centre(g.box())
    warped = _inner_frame(width, height, band)  # once for each frame, not for each pair
    other = frames.select(F.col("walk_id").alias("_w"), *(p.alias(n) for k, (x, y) in enumerate(warped) for p, n in ((x, f"_x{k}"), (y, f"_y{k}"))))
    return dets.join(other, (F.col("walk_id") == F.col("_w")) & g.in_convex(cx, cy, quad), "left_semi").select("walk_id", "det_id")


def _groups(det: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The connected group of each pair, as its smallest detection."""
    label, sides = det.copy(), [np.unique(side, return_inverse=True)[1] for side in (item, det)]
    while True:
        before = label
        for at in sides:
            low = np.full(at.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, at, label)
            label = low[at]
        if (label == before).all():
            return label


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of sorted columns begin."""
    new = np.ones(len(sorted_by[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_by])
    return np.flatnonzero(new)


def spread(low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that begin at ``low`` with ``many`` numbers each, written out: the range of each number, and the number."""
    of = np.repeat(np.arange(len(many)), many)
    return of, np.arange(len(of)) + np.repeat(low - np.cumsum(many) + many, many)


def cheapest_matches(det: np.ndarray, item: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-to-one matches of gated pairs: most matches first, then the cheapest, found in each connected group."""
    if not len(det):
        return det, item
    label = _groups(det, item)
    order = np.lexsort((item, det, far, label))
    det, item, far, at = det[order], item[order], far[order], _starts(label[order])
    ends = np.append(at[1:], len(det))
    star = np.logical_or(*(np.minimum.reduceat(x, at) == np.maximum.reduceat(x, at) for x in (det, item)))  # has one match, the first
    out = [np.stack([det[at[star]], item[at[star]]])]
    for i, j in zip(at[~star].tolist(), ends[~star].tolist(), strict=True):
        rows, cols = np.unique(det[i:j]), np.unique(item[i:j])
        cost = np.full((len(rows), len(cols)), FORBIDDEN)
        cost[np.searchsorted(rows, det[i:j]), np.searchsorted(cols, item[i:j])] = far[i:j]
        x, y = assign(cost)
        used = cost[x, y] < FORBIDDEN
        out.append(np.stack([rows[x[used]], cols[y[used]]]))
    return tuple(np.concatenate(out, axis=1))


def _medians(values: np.ndarray, at: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The median of each column in each view; ``at``: the view of each row, ascending, ``many``: the rows of each view."""
    end = np.cumsum(many)
    out = np.full((len(many), values.shape[1]), np.nan)
    some = many > 0
    low, high, last = (end - many + (many - 1) // 2)[some], (end - many + many // 2)[some], (end - 1)[some]
    for k in range(values.shape[1]):
        v = values[np.lexsort((values[:, k], at)), k]
        out[some, k] = np.where(np.isnan(v[last]), np.nan, (v[low] + v[high]) / 2)
    return out


def _supports(diff: np.ndarray, half: np.ndarray, det: np.ndarray, offset: np.ndarray, low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many detections each offset brings near an item: its pairs are ``many`` from ``low`` on, by detection. Bounded in memory."""
    out, i = np.zeros(len(offset), int), 0
    total = np.cumsum(many)
    while i < len(offset):
        j = max(i + 1, int(np.searchsorted(total, total[i] - many[i] + TOGETHER, "right")))
        of, pair = spread(low[i:j], many[i:j])
        near = np.hypot(*((diff[pair] - offset[i:j][of]) / half[pair]).T) <= 1
        of, who = of[near], det[pair[near]]
        out[i:j] = np.bincount(of[_starts(of, who)], minlength=j - i)
        i = j
    return out


def view_matches(box: np.ndarray, cls: np.ndarray, there: np.ndarray, there_cls: np.ndarray, at: np.ndarray | None = None, there_at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The detections of a commit, and the carried items (boxes in this view) that they show again.

    Each pair of a class proposes its difference, rounded to a grid, if that is within half a median box. The offset that brings most
    detections within half their own box of an item wins, the shortest and smallest of equals, and none if it has less support than
    three or a quarter of the detections; pairs within the gate after it are matched. Many commits go side by side: ``at`` and
    ``there_at`` then are the commit of each detection and item, from 0 and ascending; no commit bears on another.
    """
    at, there_at = np.zeros(len(box), int) if at is None else at, np.zeros(len(there), int) if there_at is None else there_at
    kind = pd.factorize(np.concatenate([cls, there_cls]))[0] + 1
    own, their = (k * (kind.max(initial=0) + 1) + c for k, c in ((at, kind[: len(cls)]), (there_at, kind[len(cls) :])))
    order = np.argsort(their, kind="stable")
    low, high = (np.searchsorted(their[order], own, side) for side in ("left", "right"))
    det, item = spread(low, high - low)
    item = order[item]
    if not len(det):
        return det, item
    views = int(at[-1]) + 1
    dets = np.bincount(at, minlength=views)
    size = box[:, 2:] - box[:, :2]
    diff = (there[item, :2] + there[item, 2:] - box[det, :2] - box[det, 2:]) / 2
    half = np.maximum(REACH * size[det], 1e-9)
    view = at[det]
    likely = (np.abs(diff) <= REACH * _medians(size, at, dets)[view]).all(1)
    met = view[_starts(view)]
    of, offset = np.concatenate([met, view[likely]]), np.concatenate([np.zeros((len(met), 2)), QUANTUM * np.round(diff[likely] / QUANTUM)]) + 0.0
    order = np.lexsort((offset[:, 1], offset[:, 0], of))
    order = order[_starts(of[order], *offset[order].T)]
    of, offset = of[order], offset[order]
    first, many = np.searchsorted(view, np.arange(views)), np.bincount(view, minlength=views)
    support = _supports(diff, half, det, offset, first[of], many[of])
    order = np.lexsort((offset[:, 1], offset[:, 0], np.hypot(*offset.T), -support, of))
    best = order[_starts(of[order])]
    won = np.zeros((views, 2))
    won[of[best]] = np.where((support[best] >= np.maximum(LEAST, SHARE * dets[of[best]]))[:, None], offset[best], 0.0)
    gap = np.hypot(*((diff - won[view]) / half).T)
    near = gap <= 1
    return cheapest_matches(det[near], item[near], gap[near])


def _best_sightings(item: np.ndarray, inliers: np.ndarray, seen_in: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The rows of each item's best-registered sighting, the later one of equals, in order of the items; with ``at``, of each commit."""
    at = np.zeros(len(item), int) if at is None else at
    order = np.lexsort((seen_in, inliers, item, at))
    return order[np.append(_starts(at[order], item[order])[1:], len(order)) - 1] if len(order) else order


def _matched(batches: Iterator[pa.RecordBatch], frame: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The detections of each walk's commit (place is not null) with the carried item (item is not null) that they show, and with
    ``asked``: whether their centre lies in the inner frame of an earlier view under one of the commit's transforms (h is not null)."""
    for b, at in whole_groups(batches, ["walk_id"]):
        col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
        v = {c: col(c).to_numpy(zero_copy_only=False) for c in ("place", "cls", *BOX)}
        came = {c: col(c).fill_null(-1).to_numpy() for c in ("item", "inliers", "seen_in")}
        box, item, asked = np.stack([v[c] for c in BOX], 1), np.full(b.num_rows, -1), np.zeros(b.num_rows, bool)
        view = np.repeat(np.arange(len(at) - 1), np.diff(at))
        d, k, f = np.flatnonzero((v["place"] == "inner") | (v["place"] == "band")), np.flatnonzero(col("item").is_valid()), np.flatnonzero(col("h").is_valid())
        low, high = (np.searchsorted(view[f], view[d], side) for side in ("left", "right"))
        asked[d] = transforms.in_frames(frame, col("h").flatten().to_numpy().reshape(-1, 9), box[d], *spread(low, high - low))
        k = k[_best_sightings(*(came[c][k] for c in ("item", "inliers", "seen_in")), view[k])]
        if len(d) and len(k):
            x, y = view_matches(box[d], v["cls"][d], box[k], v["cls"][k], view[d], view[k])
            item[d[x]] = came["item"][k[y]]
        got = b.set_column(b.schema.get_field_index("item"), "item", pa.array(item, mask=item < 0))
        yield got.set_column(b.schema.get_field_index("asked"), "asked", pa.array(asked)).filter(col("place").is_valid())


def _handed_on(seen: DataFrame, links: DataFrame) -> DataFrame:
    """Items of one commit a walk, moved into each later view ``b`` that theirs is linked with."""
    got = seen.join(links, "walk_id").withColumn("there", transforms.moved_box(F.col("h"), g.box()))
    return got.select("walk_id", "item", "cls", "there.*", "inliers", F.col("n").alias("seen_in"), "b").hint("rebalance", F.col("b"))


def _finished(dets: DataFrame, carried: DataFrame | None, frames: DataFrame | None, n: int, frame: np.ndarray) -> DataFrame:
    """Statuses of a commit; a new item goes by its commit and detection. A miss is never stored, so that it prompts again.

    frames: (walk_id, h), the transforms of the counted views that lie in these commits'.
    """
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    d = dets.select("walk_id", "t", "det_id", *BOX, "cls", "place", none("item", "long"), none("inliers", "long"), none("seen_in", "long"), none("h", "array<double>"), F.lit(False).alias("asked"))
    more = [x for x in (carried, frames) if x is not None]
    for x in more:
        d = d.unionByName(x, allowMissingColumns=True)
    if more:
        d = dealt(d, ["walk_id"]).mapInArrow(lambda batches: _matched(batches, frame), d.schema)
    live = F.col("place").isin("inner", "band")
    status = F.when(~live, F.col("place")).when(F.col("item").isNotNull(), "seen").when(F.col("asked"), "miss").when(F.col("place") == "inner", "new").otherwise("edge")
    item = F.when(F.col("status") == "new", F.lit(n << 32) + F.col("det_id")).otherwise(F.col("item"))
    return d.withColumn("status", status).select("walk_id", F.lit(n).cast("long").alias("n"), "det_id", "cls", "status", "t", *BOX, item.alias("item"))


def _moved_on(items: DataFrame, now: DataFrame, width: float, height: float, patience: float) -> DataFrame:
    """Items after the step to this commit: moved with the view, in time while inside it, gone after ``patience`` outside."""
    d = items.join(now, "walk_id").withColumn("there", transforms.moved_box(F.col("h"), g.box()))
    box = [F.when(F.col("h").isNull(), F.col(c)).otherwise(F.col(f"there.{c}")).alias(c) for c in BOX]
    d = d.select("walk_id", "item", "cls", *box, "seen_at", "now", F.col("h").isNotNull().alias("moved"))
    cx, cy = g.centre(g.box())
    inside = F.col("moved") & (cx >= 0) & (cx < width) & (cy >= 0) & (cy < height)
    return d.withColumn("seen_at", F.when(inside, F.col("now")).otherwise(F.col("seen_at"))).where(F.col("now") - F.col("seen_at") <= patience).select("walk_id", "item", "cls", *BOX, "seen_at")


def _zones_on(zones: DataFrame, counted: DataFrame, items: DataFrame, now: DataFrame, patience: float) -> DataFrame:
    """Zones after the step: as their items lie now, else as the view has moved for a while; others are dropped. counted: the zones' items as they lay in their own views."""
    z = zones.drop("h").join(now.withColumnRenamed("h", "step"), "walk_id")
    z = z.withColumn("on", transforms.chained(F.col("step"), F.col("motion"))).withColumn("motion", F.when(F.col("step").isNull(), F.col("motion")).otherwise(F.col("on"))).drop("on")
    cx, cy = g.centre(g.box())
    here = items.select("walk_id", "item", cx.alias("ix"), cy.alias("iy"))
    z = z.join(moved_zones(counted, here, ["walk_id", "zone"]), ["walk_id", "zone"], "left").withColumn("zone_t", F.when(F.col("h").isNotNull(), F.col("now")).otherwise(F.col("zone_t")))
    return z.withColumn("h", F.coalesce("h", F.when(F.col("now") - F.col("zone_t") <= patience, F.col("motion")))).where("h is not null").select("walk_id", "zone", "zone_t", "motion", "h")


def count_commits(dets: DataFrame, links: DataFrame, threshold: float, width: float, height: float, margin: float, band: float, motion: bool = False, dead_reckon: float = 3.0) -> DataFrame:
    """The status of every detection of every walk. dets: walk_id, n (1, 2, ...), t, det_id, box, score, cls; links: walk_id, a, b, h (nine doubles), inliers.

    Without ``motion`` items are carried by links. With it, links between neighbouring commits are the motion: items and zones move
    with it, and are lost once they have been out of view for over ``dead_reckon``. As many supersteps as the longest walk has
    commits; each reads its own commits and links from folders by number and writes its result, so a lost executor costs one step.
    """
    spark = dets.sparkSession
    base, frame = fresh_path(spark, "walks"), np.array([[band, width - band, width - band, band], [band, band, height - band, height - band]])
    place = view_place(F.col("score"), g.box(), threshold, width, height, margin, band)
    cols = [F.col("walk_id").cast("long"), F.col("n").cast("int"), F.col("t").cast("double"), F.col("det_id").cast("long"), *(F.col(c).cast("double").alias(c) for c in BOX), F.col("cls").cast("string"), place.alias("place")]
    dets.select(*cols).hint("rebalance", F.col("n")).write.partitionBy("n").parquet(f"{base}/dets")
    tied = links.select(F.col("walk_id").cast("long"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("h").cast("array<double>").alias("h"), F.col("inliers").cast("long").alias("inliers"))
    by = lambda way: spark.read.schema(f"walk_id long, h array<double>, inliers long, {'ab'.replace(way, '')} int, {way} int").parquet(f"{base}/links_{way}")
    tied.hint("rebalance", F.col("b")).write.partitionBy("b").parquet(f"{base}/links_b")
    all_links = by("b")
    all_links.hint("rebalance", F.col("a")).write.partitionBy("a").parquet(f"{base}/links_a")  # once more, by the commit that hands items on
    all_dets = spark.read.schema("walk_id long, t double, det_id long, x0 double, y0 double, x1 double, y1 double, cls string, place string, n int").parquet(f"{base}/dets")
    ways_on = by("a")
    if motion:  # when a commit was, and how the view has moved since the one before
        steps = all_links.where(F.col("a") == F.col("b") - 1).groupBy("walk_id", F.col("b").alias("n")).agg(F.max_by("h", F.struct("inliers", "h")).alias("h"))
        all_dets.groupBy("walk_id", "n").agg(F.max("t").alias("now")).join(steps, ["walk_id", "n"], "left").hint("rebalance", F.col("n")).write.partitionBy("n").parquet(f"{base}/times")
        times = spark.read.schema("walk_id long, now double, h array<double>, n int").parquet(f"{base}/times")
    last = all_dets.agg(F.max("n")).first()[0] or 0
    # Commit numbers, at most the steps there are, and for each the earlier ones that it is linked with.
    to_of = {r["b"]: sorted(r["of"]) for r in all_links.groupBy("b").agg(F.collect_set(F.when(F.col("a").between(1, F.col("b") - 1), F.col("a"))).alias("of")).collect()}
    givers = set().union(*to_of.values())
    done, handed = spark.read.schema(_STEP), spark.read.schema(_HANDED).option("basePath", f"{base}/handed")
    items = zones = counted = None
    for n in range(1, last + 1):
        own, to = all_dets.where(F.col("n") == n).drop("n"), all_links.where(F.col("b") == n)
        frames = to.select("walk_id", "h") if n in to_of else None
        carried = handed.parquet(*[f"{base}/handed/a={a}" for a in to_of[n]]).where(F.col("b") == n).drop("a", "b") if to_of.get(n) else None
        now = times.where(F.col("n") == n).drop("n") if motion else None
        if motion and n > 1:
            items = staged(_moved_on(items, now, width, height, dead_reckon), "items")
            zones = staged(_zones_on(zones, counted, items, now, dead_reckon), "zones")
            counted = staged(counted.join(zones.select("walk_id", "zone"), ["walk_id", "zone"], "left_semi"), "counted")
            held = items.select("walk_id", "item", "cls", *BOX, F.lit(_HELD).alias("inliers"), F.lit(0).cast("long").alias("seen_in"))
            carried = held if carried is None else held.unionByName(carried)
            moved = zones.select("walk_id", "h")
            frames = moved if frames is None else moved.unionByName(to.join(zones, (to["walk_id"] == zones["walk_id"]) & (to["a"] == zones["zone"]), "left_anti").select("walk_id", "h"))
        _finished(own, carried, frames, n, frame).write.parquet(f"{base}/step={n}")
        step = done.parquet(f"{base}/step={n}").where("item is not null")
        if n in givers:
            _handed_on(step, ways_on.where((F.col("a") == n) & (F.col("b") > n))).write.partitionBy("b").parquet(f"{base}/handed/a={n}")
        if motion:
            fresh = step.select("walk_id", "item", "cls", *BOX, F.col("t").alias("seen_at"))
            items = fresh if items is None else items.join(fresh, ["walk_id", "item"], "left_anti").unionByName(fresh)
            zone = now.select("walk_id", F.lit(n).cast("long").alias("zone"), F.col("now").alias("zone_t"), _nine(IDENTITY).alias("motion"), _nine(IDENTITY).alias("h"))
            zones = zone if zones is None else zones.unionByName(zone)
            cx, cy = g.centre(g.box())
            its = step.select("walk_id", F.lit(n).cast("long").alias("zone"), "item", cx.alias("cx"), cy.alias("cy"))
            counted = its if counted is None else counted.unionByName(its)
    if not last:
        return spark.createDataFrame([], STATUS_SCHEMA)
    return done.parquet(*[f"{base}/step={i}" for i in range(1, last + 1)]).select("walk_id", "n", "det_id", "cls", "status")
