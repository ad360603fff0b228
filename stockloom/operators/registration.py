"""Which keyframes may show the same place: proposals from an inverted index, and robust fits of matched points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.plans.groups import whole_groups

TOGETHER, ALIKE = 1 << 18, 32  # numbers at once; groups of up to so many matches are fitted together by size


def sign_word(vector: Column, bits: int, first: int = 0) -> Column:
    """A descriptor quantised to the signs of ``bits`` of its components, from the one at ``first``."""
    return F.aggregate(F.slice(vector, first + 1, bits), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0))


def posting_words(descriptors: DataFrame, bits: int, more: int, most: int) -> DataFrame:
    """``(walk_id, n, word)``: the distinct visual words of each keyframe. descriptors: walk_id, n, v.

    A word that over ``most`` keyframes of a walk have says little and would pair them all: it is split by ``more`` further bits, not dropped.
    """
    d = descriptors.select("walk_id", "n", sign_word(F.col("v"), bits).alias("_w"), sign_word(F.col("v"), more, bits).alias("_m"))
    # Entries of a word come together once, sorted, so that copies are next to each other and the descriptors are made once.
    near, whole = Window.partitionBy("walk_id", "_w").orderBy("n", "_m"), Window.partitionBy("walk_id", "_w")
    new = lambda c: F.coalesce(F.lag(c).over(near) != F.col(c), F.lit(True))
    d = d.withColumn("_n", new("n")).withColumn("_new", F.col("_n") | new("_m")).withColumn("_often", F.sum(F.col("_n").cast("long")).over(whole) > most)
    split = F.lit(2 ** (bits + more)) + F.col("_w") * 2**more + F.col("_m")
    return d.where(F.when(F.col("_often"), F.col("_new")).otherwise(F.col("_n"))).select("walk_id", "n", F.when(F.col("_often"), split).otherwise(F.col("_w")).alias("word"))


def proposed_pairs(postings: DataFrame, least: int = 1) -> DataFrame:
    """``(walk_id, a, b, shared)``: keyframes a < b of a walk that share ``least`` words or more; only entries of one posting list meet."""
    a = postings.select("walk_id", "word", F.col("n").alias("a"))
    b = postings.select("walk_id", "word", F.col("n").alias("b"))
    return a.join(b, ["walk_id", "word"]).where("a < b").groupBy("walk_id", "a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def consistent_links(links: DataFrame) -> DataFrame:
    """Links of each commit, strongest first, without those that clash with a kept stronger one.

    links: walk_id, commit_n, a, inliers, foes (the candidates that a link clashes with). A fold over the sorted links of one commit, inside Spark.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("inliers")).alias("o"), "a", "foes", "inliers")))
    per = links.groupBy("walk_id", "commit_n").agg(order.alias("l"))
    start = F.array().cast("array<struct<a: bigint, inliers: bigint>>")
    keep = lambda kept, x: F.when(F.exists(kept, lambda k: F.array_contains(x["foes"], k["a"])), kept).otherwise(F.concat(kept, F.array(F.struct(x["a"].cast("long").alias("a"), x["inliers"].cast("long").alias("inliers")))))
    return per.select("walk_id", "commit_n", F.explode(F.aggregate("l", start, keep)).alias("k")).select("walk_id", "commit_n", "k.a", "k.inliers")


def similarity(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """``(a, b, x, y)`` of the least-squares similarity from p to q: ``q = [[a, -b], [b, a]] p + (x, y)``."""
    mid, to = p.mean(0), q.mean(0)
    u, v = p - mid, q - to
    size = (u * u).sum()
    if size <= 0:
        return None
    a, b = (u * v).sum() / size, (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum() / size
    return np.array([a, b, to[0] - a * mid[0] + b * mid[1], to[1] - b * mid[0] - a * mid[1]])


def consensus(p: np.ndarray, q: np.ndarray, within: float, most: int = 64) -> tuple[np.ndarray, np.ndarray] | None:
    """The similarity that most matches agree with, refitted on them, and which they are. Deterministic: every pair of matches proposes
    one, of more than ``most`` matches those at even places of the input propose while all vote; the first of equals wins."""
    own = np.arange(len(p)) if len(p) <= most else np.linspace(0, len(p) - 1, most).astype(int)
    i, j = (own[x] for x in np.triu_indices(len(own), 1))
    zp, zq = p @ [1, 1j], q @ [1, 1j]
    apart = np.abs(zp[j] - zp[i]) > 1e-9
    i, j = i[apart], j[apart]
    if not len(i):
        return None
    turn = (zq[j] - zq[i]) / (zp[j] - zp[i])
    shift = zq[i] - turn * zp[i]
    near = np.abs(turn[:, None] * zp[None] + shift[:, None] - zq[None]) <= within
    best = near[np.argmax(near.sum(1))]
    fit = similarity(p[best], q[best])
    return None if fit is None else (fit, np.hypot(*(np.stack([fit[0] * p[:, 0] - fit[1] * p[:, 1] + fit[2], fit[1] * p[:, 0] + fit[0] * p[:, 1] + fit[3]], 1) - q).T) <= within)


def consensus_many(p: np.ndarray, q: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """``consensus`` of many groups of as many matches each (groups, matches, 2), all of which propose: ``(a, b, x, y)`` by group, nan where there is none, and how many agree."""
    i, j = np.triu_indices(p.shape[1], 1)
    fits, agree = np.full((len(p), 4), np.nan), np.zeros(len(p), np.int64)
    if not len(i):
        return fits, agree
    zp, zq = p @ [1, 1j], q @ [1, 1j]
    gap = zp[:, j] - zp[:, i]
    apart = np.abs(gap) > 1e-9
    turn = (zq[:, j] - zq[:, i]) / np.where(apart, gap, 1)
    shift = zq[:, i] - turn * zp[:, i]
    near = np.abs(turn[..., None] * zp[:, None] + shift[..., None] - zq[:, None]) <= within
    best = np.take_along_axis(near, np.argmax(np.where(apart, near.sum(2), -1), 1)[:, None, None], 1)[:, 0, :, None]
    many = np.maximum(best.sum(1), 1)
    mid, to = (p * best).sum(1) / many, (q * best).sum(1) / many
    u, v = (p - mid[:, None]) * best, (q - to[:, None]) * best
    size = (u * u).sum((1, 2))
    some = apart.any(1) & (size > 0)
    a, b = ((u * v).sum((1, 2)) / np.where(some, size, 1), (u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]).sum(1) / np.where(some, size, 1))
    x, y = to[:, 0] - a * mid[:, 0] + b * mid[:, 1], to[:, 1] - b * mid[:, 0] - a * mid[:, 1]
    moved = np.stack([a[:, None] * p[..., 0] - b[:, None] * p[..., 1] + x[:, None], b[:, None] * p[..., 0] + a[:, None] * p[..., 1] + y[:, None]], 2)
    fits[some] = np.stack([a, b, x, y], 1)[some]
    agree[some] = (np.hypot(*np.moveaxis(moved - q, 2, 0)) <= within).sum(1)[some]
    return fits, agree


def robust_fits(matches: DataFrame, keys: list[str], within: float, most: int = 64) -> DataFrame:
    """``(keys, matches, agree, a, b, x, y)`` of each group of matched points (keys, id, px, py, qx, qy): the similarity that most agree with.

    Groups are the matches of one zone or pair of views. A group without two different points has null numbers.
    """
    names = ["matches", "agree", "a", "b", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, keys):
            p, q = (np.stack([t.column(t.schema.get_field_index(c)).to_numpy() for c in pair], 1) for pair in (("px", "py"), ("qx", "qy")))
            size = np.diff(at)
            fits, agree = np.full((len(size), 4), np.nan), np.zeros(len(size), np.int64)
            for n in np.unique(size):
                own, step = np.flatnonzero(size == n), max(1, TOGETHER // int(n) ** 3)
                if n > min(most, ALIKE):
                    for g in own:
                        found = consensus(p[at[g] : at[g + 1]], q[at[g] : at[g + 1]], within, most)
                        if found is not None:
                            fits[g], agree[g] = found[0], found[1].sum()
                    continue
                for part in (own[k : k + step] for k in range(0, len(own), step)):
                    rows = at[part][:, None] + np.arange(n)
                    fits[part], agree[part] = consensus_many(p[rows], q[rows], within)
            first, none = pa.array(at[:-1]), np.isnan(fits[:, 0])
            columns = [*(t.column(t.schema.get_field_index(k)).take(first) for k in keys), pa.array(size), pa.array(agree), *(pa.array(c, pa.float64(), mask=none) for c in fits.T)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *names])

    own = matches.select(*(F.col(k).cast("long") for k in keys), F.col("id").cast("long"), *(F.col(c).cast("double") for c in ("px", "py", "qx", "qy")))
    schema = ", ".join(f"{k} long" for k in keys) + ", matches long, agree long, a double, b double, x double, y double"
    return own.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, schema)
