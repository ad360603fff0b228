"""Near-duplicate vectors by counting collisions on sorted one-dimensional projections.

There are ``T`` tables. Table ``t`` sorts the vectors by a random projection ``p_t``, inside cells made of ``k`` random
hyperplane signs (``k`` follows the number of vectors, so that a cell holds about ``CELL`` of them whatever the size). A pair
collides in a table if it shares the cell and lies within a window of ``+-w`` centred on the query.
``calibrate`` picks ``T`` so that a pair at the threshold reaches the required number of collisions with the wanted
probability. A pair is worked on where it first collides: its collisions over all tables are counted,
and if they suffice its cosine is computed in double precision.

Cells are dealt into bounded block pairs. Pairs never leave a task: what leaves are link counts and a
spanning forest of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.blocks import block_pairs, forest, map_groups
from stockloom.operators.graph import connected_components
from stockloom.plans.durable import staged

CELL, BLOCK, MIN_COUNT = 256, 512, 2
STEP = 2.0**20


def window(cosine: float) -> float:
    """Half width of the window: 1.645 standard deviations of the projected difference of a pair at ``cosine``."""
    return 1.645 * math.sqrt(2 - 2 * cosine)


def calibrate(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """``(k, T)``: signs of a cell, and tables so that ``MIN_COUNT`` collisions come with probability ``recall``."""
    k = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
    p = (1 - math.acos(cosine) / math.pi) ** k * 0.90
    tables = MIN_COUNT
    while sum(math.comb(tables, i) * p**i * (1 - p) ** (tables - i) for i in range(MIN_COUNT)) > 1 - recall:
        tables += 1
    return k, tables


@lru_cache(8)
def _directions(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([11, dim])
    return np.rint(STEP * rng.standard_normal((dim, tables))), np.rint(STEP * rng.standard_normal((dim, tables * k)))


def places(unit: np.ndarray, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and position of each unit vector in each table.

    Products are of whole numbers under 2^53, so they are exact: a vector has the same places in whichever block it is.
    """
    line, planes = _directions(unit.shape[1], k, tables)
    whole = np.rint(STEP * unit)
    sign = (whole @ planes > 0).reshape(len(unit), tables, k) if k else np.zeros((len(unit), tables, 0), bool)
    return sign @ (1 << np.arange(k, dtype=np.int64)), whole @ line / STEP**2


def _units(raw: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(kind: type):
    """Vectors as bytes of their own precision, and a key that equal ones share; both null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for v in batch.column(1):
                x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(kind)
                ok = x is not None and v.values.null_count == 0 and len(x) and np.isfinite(x).all() and x.any()
                raw = (x + kind(0)).tobytes() if ok else None
                keys.append(xxhash.xxh3_128_digest(raw) if ok else None)
                vecs.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["_id", "key", "vec"])

    return run


def _cells(k: int, tables: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(batch.schema.get_field_index("vec")).to_pylist()
            out: list = [None] * len(vec)
            for size in {len(v) for v in vec}:
                at = [i for i, v in enumerate(vec) if len(v) == size]
                cell, _ = places(_units([vec[i] for i in at], kind), k, tables)
                for i, row in zip(at, (cell * tables + np.arange(tables)) * 65536 + size // 4 % 65536, strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["rep", "cells"])

    return run


def vector_links(classes: DataFrame, k: int, tables: int, cosine: float, kind: type) -> DataFrame:
    """``(rep, links, root)``: links found in one block, weighted by class size, and an edge of their spanning forest."""
    cells = classes.select("rep", "vec").mapInArrow(_cells(k, tables, kind), "rep long, cells array<long>").select("rep", F.explode("cells").alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("c")).where("c > 1")
    rows = block_pairs(cells.join(sizes, "cell"), F.col("c"), ["rep"], BLOCK).join(classes.select("rep", "size", "vec"), "rep")
    w = window(cosine)

    def work(t: pa.RecordBatch) -> dict | None:
        rep, size, blk = (t[c].to_numpy(zero_copy_only=False) for c in ("rep", "size", "blk"))
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        unit = _units(t["vec"].to_pylist(), kind)
        table = t["cell"][0].as_py() // 65536 % tables
        cell, spot = places(unit, k, tables)
        a, b = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        b = b[np.argsort(spot[b, table], kind="stable")]
        line = spot[b, table]
        start, stop = np.searchsorted(line, spot[a, table] - w, "left"), np.searchsorted(line, spot[a, table] + w, "right")
        many = stop - start
        x = np.repeat(a, many)
        y = b[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)]
        live = x < y if lo == hi else rep[x] != rep[y]
        x, y = x[live], y[live]
        count = np.zeros(len(x), np.int32)
        for i in range(tables):
            met = (cell[x, i] == cell[y, i]) & (np.abs(spot[x, i] - spot[y, i]) <= w)
            if i < table:  # an earlier table has the pair
                x, y, count = x[~met], y[~met], count[~met]
            else:
                count += met
        live = count >= min(MIN_COUNT, tables)
        x, y = x[live], y[live]
        near = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
        x, y = x[near], y[near]
        if not len(x):
            return None
        links = np.bincount(x, size[y], len(rep)) + np.bincount(y, size[x], len(rep))
        far, up = forest(len(rep), x, y)
        root = np.arange(len(rep))
        root[far] = up
        own = np.flatnonzero(links)
        return {"rep": rep[own], "links": links[own].astype(np.int64), "root": rep[root[own]]}

    return map_groups(rows.select("cell", "lo", "hi", "blk", "rep", "size", "vec"), ["cell", "lo", "hi"], work, "rep long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, recall: float = 0.985) -> DataFrame:
    """``(id, n_links, component_id)``, one row for each row of ``vectors``.

    Links vectors of one dimension with a cosine of ``cosine`` or more in double precision. Each such pair is found with
    probability ``recall`` at least (more above the threshold); none below it is linked. Equal vectors always link.
    Vectors that are null, empty or zero, or hold null or non-finite components link with nothing. ``n_links`` counts
    rows, repeated ids too. Other columns are ignored.
    """
    kind = np.float32 if vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vec_col].dataType.containsNull) else np.float64
    plain = T.ArrayType(T.FloatType() if kind is np.float32 else T.DoubleType())
    rows = staged(vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast(plain).alias("v")).mapInArrow(_classes(kind), "_id long, key binary, vec binary"), "vectors")
    classes = staged(rows.where("key is not null and _id is not null").groupBy("key").agg(F.min("_id").alias("rep"), F.count("*").alias("size"), F.first("vec").alias("vec")), "classes")
    k, tables = calibrate(classes.count(), cosine, recall)
    found = staged(vector_links(classes, k, tables, cosine, kind), "links")
    groups = connected_components(found.select("rep", "root"), "rep", "root").withColumnRenamed("node", "rep")
    own = (
        classes.select("key", "rep", "size")
        .join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(groups, "rep", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return rows.select("_id", "key").join(own, "key", "left").select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "_id").alias("component_id"))
