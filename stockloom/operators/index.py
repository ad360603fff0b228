"""Nearest neighbours through an inverted-file index: every row lies in the list of its nearest centre, a query looks in a few lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.plans.groups import dealt, whole_groups

SAMPLE, ROUNDS, BLOCK, SLICE = 20_000, 10, 4096, 256


def _sample(vectors: DataFrame, many: int) -> np.ndarray:
    rows = vectors.select(F.xxhash64("id").alias("h"), F.col("v").cast("array<double>").alias("v")).orderBy("h", "id").limit(many).collect()
    x = np.array([r["v"] for r in rows], float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else np.zeros((1, 1))


def fit_centres(vectors: DataFrame, lists: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit centres of ``lists`` groups of directions, by spherical k-means on the ``sample`` rows with the smallest id hashes.

    The sample is a bound on what the fit sees, not on what is indexed. vectors: id, v.
    """
    x = _sample(vectors, sample)
    centres = x[: min(lists, len(x))].copy()  # a hash order is a random draw
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def calibrated_probes(vectors: DataFrame, centres: np.ndarray, k: int, recall: float, sample: int = 4000) -> int:
    """The fewest lists that hold a share ``recall`` of the ``k`` nearest neighbours within a sample of rows; in the whole table neighbours are
    nearer, and lie in fewer lists. Up to 1,000 rows of the sample ask."""
    x = _sample(vectors, sample)
    asks = x[: min(1000, len(x))]
    sim = asks @ x.T
    sim[np.arange(len(asks)), np.arange(len(asks))] = -np.inf
    near = np.argsort(-sim, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    home = np.argmax(x @ centres.T, axis=1)
    place = np.argsort(np.argsort(-(asks @ centres.T), axis=1, kind="stable"), axis=1)  # of each list in a row's order
    needed = np.sort(np.take_along_axis(place, home[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1


def _nearest(centres: np.ndarray, many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, centres.shape[1]))
            near = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :many]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near.tolist(), pa.list_(pa.int32()))], ["id", "v", "at", "lists"])

    return run


def indexed(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """``(id, v, at, list)``: every row with its ``probes`` nearest lists; ``centres`` go to the tasks, ``lists`` times dimension numbers.

    ``at`` is a whole number that orders rows in time, null if there is no such column.
    """
    at = F.col("at").cast("long") if "at" in vectors.columns else F.lit(None).cast("long").alias("at")
    rows = vectors.select(F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v"), at)
    return rows.mapInArrow(_nearest(centres, probes), "id long, v array<double>, at long, lists array<int>").select("id", "v", "at", F.explode("lists").alias("list"))


def knn_indexed(queries: DataFrame, gallery: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """``(q, rank, g, sim)``: the ``k`` most similar of the rows in the ``probes`` lists nearest to a query, by cosine, ties by id; unit vectors.

    A row is not its own neighbour. A list with over ``BLOCK`` rows is dealt out in blocks, and so are its queries; each pair of blocks meets
    in one task, ``SLICE`` queries at a time. With as many probes as lists the result is exact. Where queries and gallery have a whole number ``at``, a query sees earlier rows only (an as-of search).
    """
    rows, asks = indexed(gallery, centres), indexed(queries, centres, probes)
    blocks = lambda df, n: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))  # noqa: E731  # a row for each list
    sizes = blocks(rows, "blocks").join(blocks(asks, "parts"), "list")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.join(sizes, "list").select("list", own("blocks").alias("block"), every("parts").alias("part"), F.lit(1).alias("side"), "id", "v", "at")
    asks = asks.join(sizes, "list").select("list", every("blocks").alias("block"), own("parts").alias("part"), F.lit(0).alias("side"), "id", "v", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in whole_groups(batches, ["list", "block", "part"]):
            side, ids = b.column(3).to_numpy(), b.column(4).to_numpy()
            at_ = b.column(6).cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN, which is later than nothing
            v = b.column(5).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                asking, other = np.flatnonzero(side[i:j] == 0) + i, np.flatnonzero(side[i:j] == 1) + i
                if not len(asking) or not len(other):
                    continue
                other = other[np.argsort(ids[other], kind="stable")]
                there = v[other].T
                for lo in range(0, len(asking), SLICE):
                    own = asking[lo : lo + SLICE]
                    sim = np.round(v[own] @ there, 9)
                    sim[(ids[own][:, None] == ids[other][None]) | (at_[other][None] >= at_[own][:, None])] = -np.inf
                    best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    got = np.take_along_axis(sim, best, 1).ravel()
                    live = np.isfinite(got)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[own], best.shape[1])[live]), pa.array(ids[other][best.ravel()][live]), pa.array(got[live])], ["q", "g", "sim"])

    best = dealt(members.unionByName(asks), ["list", "block", "part"]).mapInArrow(run, "q long, g long, sim double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "g"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("q", "rank", "g", "sim")
