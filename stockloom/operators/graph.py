"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.plans.durable import staged
from stockloom.plans.groups import dealt


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, at = np.unique(np.concatenate([batch["a"].to_numpy(), batch["b"].to_numpy()]), return_inverse=True)
        u, v = at[: batch.num_rows], at[batch.num_rows :]
        low, before = np.arange(len(nodes)), None
        while before is None or (low != before).any():
            before, least = low.copy(), np.minimum(low[u], low[v])
            np.minimum.at(low, u, least)
            np.minimum.at(low, v, least)
            low = low[low]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[low])], ["a", "b"])


def contracted(edges: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """``(a, b)``: edges with the same components (ids are whole numbers, not null), each Arrow batch's as stars around their smallest nodes.

    Edges of equal ``keys`` come one after another; where these hold most of a component, few rounds are left for the others.
    """
    return dealt(edges.select(*keys, F.col(a).alias("a"), F.col(b).alias("b")), keys).select("a", "b").mapInArrow(_stars, "a long, b long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; component is its smallest node.

    Loops, repeated and null edges are ignored. Each round shuffles the edges only, aggregates
    before shuffling, and is written to the shared folder, so a lost executor costs one round.
    An empty edge list gives an empty result.
    """
    e = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct(),
        "edges",
    )
    before = _signature(e)
    while before[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join deals both sides anew and Spark can split a node that holds a large part of all edges.
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = staged(
            small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
        now = _signature(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
