"""Dealing the members of groups into bounded blocks, so that no task holds an unbounded group.

A group of ``c`` members gets ``ceil(c / size)`` blocks; a member goes to every pair of blocks that
holds its own. All pairs of members meet in exactly one block pair: those of one block in ``(i, i)``,
the others in ``(i, j)``. Where only the components of the links are wanted, ``grouped_components`` moves a member far less often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.graph import connected_components
from stockloom.plans.durable import staged
from stockloom.plans.groups import dealt, whole_groups


def block_pairs(df: DataFrame, count: Column, salt: list[str], size: int) -> DataFrame:
    """Adds ``lo``, ``hi`` and ``blk``: one row for each block pair of which the row is a member."""
    nb = F.ceil(count / F.lit(size)).cast("int")
    return (
        df.withColumn("_nb", nb)
        .withColumn("blk", F.pmod(F.xxhash64(*salt), F.col("_nb")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .withColumn("lo", F.least("blk", "_o"))
        .withColumn("hi", F.greatest("blk", "_o"))
        .drop("_nb", "_o")
    )


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Applies ``work`` to the rows of each group of ``keys``; it returns columns of ``schema``, or None for no rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in whole_groups(batches, keys):
            got = [x for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if (x := work(b.slice(i, j - i))) is not None]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[n] for x in got])) for n in names], names)

    return dealt(df, keys).mapInArrow(run, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected component of ``n`` nodes under edges ``a-b``: (member, smallest member)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[label])
        while (nxt := new[new]).tobytes() != new.tobytes():
            new = nxt
        if new.tobytes() == label.tobytes():
            break
        label = new
        live = label[a] != label[b]
        a, b = a[live], b[live]
    far = np.flatnonzero(label != np.arange(n))
    return far, label[far]


def sides(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of ``grouped_components``: nodes, labels, and the rows to compare; all with all if there is one side only."""
    node, label, role = (t[c].to_numpy(zero_copy_only=False) for c in ("node", "label", "role"))
    a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    return node, label, a, b if len(b) else a


def unlike(label: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places ``x, y`` in ``a`` and ``b`` the pairs of rows that no link joins yet, each once."""
    x, y = a[x], b[y]
    live = (label[x] != label[y]) & (x < y if a is b else True)
    return x[live], y[live]


def star(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """A spanning forest of the labels that the pairs ``x, y`` join."""
    known, at = np.unique(label, return_inverse=True)
    far, root = forest(len(known), at[x], at[y])
    return {"a": known[far], "b": known[root]}


SHRINKS = 0.7


def grouped_components(members: DataFrame, group: str, size: int, payload: Callable[[DataFrame], DataFrame], work: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """``(node, component)`` of the links that ``work`` finds between nodes that share a group.

    members: ``group``, node and c, the nodes of the group. First the nodes of each group meet in blocks of ``size``, each once.
    Groups of several blocks go on: a representative of each component in them meets the others, in blocks again, as long as
    that leaves clearly fewer. At last only the nodes outside a group's largest component are open: they meet all others that they
    are not joined with. A node outside moves once for each block of its group, any other once for each block of open nodes,
    so that a group whose nodes are nearly all alike costs about its own size, not its square. A group of nodes that no link
    joins is still compared with itself block by block. ``payload`` adds columns by node; ``work`` gets them with node, label
    and role.
    """
    keys = [group, "lo", "hi"]

    def meet(rows: DataFrame, seed: int) -> DataFrame:
        dealt_ = rows.withColumn("lo", F.pmod(F.xxhash64(F.lit(seed), "node", group), F.ceil(F.col("c") / size)).cast("int"))
        return map_groups(payload(dealt_.select(group, "node", "lo", F.lit(-1).alias("hi"), F.lit(0).alias("role"), F.col("node").alias("label"))), keys, work, "a long, b long")

    found = connected_components(meet(members, 0))
    large = members.where(F.col("c") > size)
    left, round_ = large.count(), 0
    while left:
        found = staged(found, "joined")
        star_edges = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        own = large.join(found, "node", "left").select(group, "node", "c", F.coalesce("component", "node").alias("label"))
        some = staged(own.select(group, F.col("label").alias("node")).distinct(), "representatives")
        some = some.join(some.groupBy(group).agg(F.count("*").alias("c")).where("c > 1"), group)
        before, left, round_ = left, some.count(), round_ + 1
        if not left or left > SHRINKS * before:
            break
        found = connected_components(star_edges.unionByName(meet(some, round_)))
    if not left:
        return found
    most = own.groupBy(group, "c", "label").agg(F.count("*").alias("m")).groupBy(group, "c").agg(F.max(F.struct("m", "label")).alias("top"))
    most = most.where("top.m < c").select(group, F.col("top.label").alias("main"), F.ceil((F.col("c") - F.col("top.m")) / size).cast("int").alias("opens"), F.ceil(F.col("c") / size).cast("int").alias("alls"))
    at = lambda seed, many: F.pmod(F.xxhash64(F.lit(seed), "node", group), many).cast("int")
    upto = lambda many: F.sequence(F.lit(0), F.col(many) - 1)
    whole = F.transform(upto("opens"), lambda o: F.struct(F.lit(1).alias("role"), o.alias("lo"), at(-1, F.col("alls")).alias("hi")))
    opened = F.transform(upto("alls"), lambda h: F.struct(F.lit(0).alias("role"), at(-2, F.col("opens")).alias("lo"), h.alias("hi")))
    last = own.join(most, group).select(group, "node", "label", F.explode(F.when(F.col("label") == F.col("main"), whole).otherwise(F.concat(whole, opened))).alias("r"))
    more = map_groups(payload(last.select(group, "node", "r.lo", "r.hi", "r.role", "label")), keys, work, "a long, b long")
    return connected_components(star_edges.unionByName(more))
