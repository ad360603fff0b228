"""Near-duplicate texts by SetSketch registers.

1. Each text becomes a set of word shingles. A SetSketch of the set has ``m`` registers
   ``floor(1 - log_b(h))`` of the exponentially distributed minimum hash ``h``, cut to 0..q+1
   (Ertl, 2021). Equal sets are one class from here on.
2. Registers are cut into bands. Classes with an equal band are a bucket; buckets with the same
   members are worked on once, in blocks (``grouped_components``). For each pair in a block
   the joint likelihood of the register order counts, given both set sizes, decides whether the
   maximum-likelihood similarity reaches a relaxed threshold. Only a spanning forest leaves the task.
3. The connected components of that forest are families of candidates. Families are worked on in blocks again,
   now with whole texts, and links are confirmed on full shingle sets. A pair is skipped only if confirmed links
   already join it.
4. Connected components of the confirmed links are the groups.

Nothing is capped: a pair at the threshold is missed only if no band agrees or its likelihood
estimate is far too low (about 7e-5 and 4e-5 at 80 percent, 8e-7 and 9e-6 at 85).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.blocks import grouped_components, sides, star, unlike
from stockloom.llm.text import WORD
from stockloom.plans.durable import staged

BASE, RATE, TOP = 1.001, 20.0, 65535
BANDS, ROWS = 24, 5
M = BANDS * ROWS
BUCKET_BLOCK, FAMILY_BLOCK = 512, 256
_P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words; it forgets all when it grows over ``most``."""

    most = 500_000

    def __missing__(self, w: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, words: dict, k: int = 5) -> np.ndarray:
    """Hashes of the ``k``-word shingles of a text in text order; fewer words give one, no word none."""
    w = text.lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    if len(w) < k:
        acc = np.full(1, len(w), np.uint64)
        for i in range(len(w)):
            acc = acc * _P + h[i : i + 1]
        return _mix(acc)
    acc = h[: len(w) - k + 1].copy()
    for i in range(1, k):
        acc = acc * _P + h[i : len(w) - k + 1 + i]
    return _mix(acc)


def _multipliers(m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return tuple(rng.integers(0, 2**32, m, dtype=np.uint32) | np.uint32(1) for _ in range(2))


def registers(sets: list[np.ndarray], m: int = M, seed: int = 7) -> np.ndarray:
    """SetSketch registers, one row for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x, y = (flat >> np.uint64(32)).astype(np.uint32), flat.astype(np.uint32)
    low = np.empty((m, len(sets)), np.uint32)
    for i, (a, b) in enumerate(zip(*_multipliers(m, seed), strict=True)):
        low[i] = np.minimum.reduceat(x * a + y * b, starts)
    h = -np.log1p(-(low.T.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _sketches(id_col: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            at = 0
            while at < batch.num_rows:
                raw, size, end = [], 0, at
                while end < batch.num_rows and size < 400_000:
                    raw.append(shingles(texts[end].as_py(), words, k))
                    size += len(raw[-1])
                    end += 1
                full = [i for i, s in enumerate(raw) if len(s)]
                regs = registers([raw[i] for i in full]) if full else None
                own = dict(zip(full, range(len(full)), strict=True))
                sets = [np.unique(s) for s in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, end - at),
                        batch.column(2).slice(at, end - at),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([regs[own[i]].tobytes() if i in own else None for i in range(len(sets))], pa.binary()),
                    ],
                    [id_col, "text_hash", "n_shingles", "set_hash", "regs"],
                )
                at = end

    return run


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """``(id, text_hash, n_shingles, set_hash, regs)``: sketches merge by the larger value of each register."""
    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(_sketches(id_col, k), f"{id_col} long, text_hash long, n_shingles long, set_hash binary, regs binary")


def _slope(dp, dm, d0, nu, nv, j):
    """Derivative at similarity ``j`` of the joint log-likelihood; it falls as ``j`` grows."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    c, ln_b = (BASE - 1) / BASE, np.log(BASE)
    xp, xm = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    pp, pm = -np.log1p(-c * xp) / ln_b, -np.log1p(-c * xm) / ln_b
    gp, gm = -c * v / (1 - c * xp) / ln_b, -c * u / (1 - c * xm) / ln_b
    return dp * gp / pp + dm * gm / pm - d0 * (gp + gm) / np.maximum(1 - pp - pm, 1e-12)


def likely(ra: np.ndarray, na: np.ndarray, rb: np.ndarray, nb: np.ndarray, j: float) -> np.ndarray:
    """Whether the maximum-likelihood similarity is ``j`` or more, for all of ``ra`` against all of ``rb``."""
    eq = np.zeros((len(ra), len(rb)), np.int16)
    gt = np.zeros((len(ra), len(rb)), np.int16)
    at, bt = np.ascontiguousarray(ra.T), np.ascontiguousarray(rb.T)
    for x, y in zip(at, bt, strict=True):
        eq += x[:, None] == y[None, :]
        gt += x[:, None] > y[None, :]
    nu, nv = na[:, None].astype(float), nb[None, :].astype(float)
    fits = np.minimum(nu, nv) >= j * np.maximum(nu, nv)
    m = ra.shape[1]
    return fits & ((eq == m) | (_slope(gt, m - eq - gt, eq, nu, nv, j) >= 0))


def _regs(col: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, m)


def candidate_families(classes: DataFrame, relaxed: float) -> DataFrame:
    """``(node, component)`` of the likely pairs that share a band; classes has node, n_shingles, regs."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * width + 1, F.lit(width))))
    bands = classes.select("node", F.explode(keys).alias("bucket"))
    buckets = (
        bands.groupBy("bucket")
        .agg(F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"))
        .where("c > 1 and low <> high")
        .groupBy("c", "low", "high", "x")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "c")
    )

    def work(t: pa.RecordBatch) -> dict | None:
        _, label, a, b = sides(t)
        n, regs = t["n_shingles"].to_numpy(), _regs(t["regs"], M)
        return star(label, *unlike(label, a, b, *np.nonzero(likely(regs[a], n[a], regs[b], n[b], relaxed))))

    members = staged(bands.join(buckets, "bucket").select("bucket", "node", "c"), "buckets")
    return grouped_components(members, "bucket", BUCKET_BLOCK, lambda rows: rows.join(classes.select("node", "n_shingles", "regs"), "node"), work)


def confirmed_components(texts: DataFrame, families: DataFrame, threshold: int, relaxed: float, k: int) -> DataFrame:
    """``(node, component)`` of the pairs with ``100 * intersection >= threshold * union`` within families.

    texts: node, text; families: node, component. Families grow with the corpus, so they are never broadcast.
    """
    sizes = families.groupBy("component").agg(F.count("*").alias("c"))
    members = staged(families.withColumnRenamed("component", "family").join(sizes.withColumnRenamed("component", "family"), "family").select("family", "node", "c"), "members")

    def work(t: pa.RecordBatch) -> dict | None:
        words = _Words()
        sets = [np.unique(shingles(x, words, k)) for x in t["text"].cast(pa.large_binary()).to_pylist()]
        _, label, a, b = sides(t)
        n = np.array([len(s) for s in sets])
        regs = registers(sets)
        x, y = unlike(label, a, b, *np.nonzero(likely(regs[a], n[a], regs[b], n[b], relaxed)))
        near = np.argsort(-np.minimum(n[x], n[y]) / np.maximum(n[x], n[y]), kind="stable")
        known, at = np.unique(label, return_inverse=True)
        root = list(range(len(known)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        one, other = [], []
        for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
            p, q = top(at[i]), top(at[j])
            if p == q:
                continue
            s, u = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            spot = np.searchsorted(u, s)
            both = int((u[np.minimum(spot, len(u) - 1)] == s).sum())
            if 100 * both >= threshold * (len(s) + len(u) - both):
                root[p] = q
                one.append(label[i])
                other.append(label[j])
        return {"a": np.array(one, np.int64), "b": np.array(other, np.int64)}

    return grouped_components(members, "family", FAMILY_BLOCK, lambda rows: rows.join(texts.hint("merge"), "node"), work)


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: int, k: int, margin: float) -> DataFrame:
    """``(_id, text_hash, n_shingles, first)`` for each row; first: the smallest ``(_id, text_hash)`` of its group, null without shingles.

    A class of equal sets goes by its smallest id; where one id stands for several classes, by a hash of its set.
    """
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    marks = staged(sketch(d, "_id", "text", k), "sketches")
    some = marks.where("n_shingles > 0 and _id is not null").groupBy("set_hash").agg(F.min(F.struct("_id", "text_hash")).alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    shared = F.count("*").over(Window.partitionBy("low._id")) > 1
    classes = staged(some.withColumn("node", F.when(shared, F.xxhash64("set_hash")).otherwise(F.col("low._id"))), "classes")
    relaxed = threshold / 100 - margin
    families = staged(candidate_families(classes, relaxed), "families")
    wanted = families.join(classes.select("node", F.col("low._id").alias("_id"), F.col("low.text_hash").alias("text_hash")), "node").select("_id", "text_hash", "node")
    own = d.withColumn("text_hash", F.xxhash64("text"))
    texts = staged(own.join(wanted.hint("merge"), ["_id", "text_hash"]).dropDuplicates(["_id", "text_hash"]).select("node", "text"), "texts")
    groups = confirmed_components(texts, families, threshold, relaxed, k)
    joined = staged(classes.select("set_hash", "node", "low").join(groups, "node", "left").select("set_hash", "low", F.coalesce("component", "node").alias("group")), "groups")
    firsts = joined.groupBy("group").agg(F.min("low").alias("first"))
    return marks.select("_id", "text_hash", "n_shingles", "set_hash").join(joined.join(firsts, "group").select("set_hash", "first"), "set_hash", "left").drop("set_hash")


def near_duplicate_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, k: int = 5, margin: float = 0.15) -> DataFrame:
    """``(id, n_shingles, component_id)``, one row for each row of ``docs``.

    Links two texts whose sets of ``k``-word shingles (ASCII lower case, words cut at ASCII white space) have a
    Jaccard similarity of ``threshold`` percent or more; ``component_id`` is the smallest id reachable by links.
    Texts with fewer than ``k`` words have one shingle, their whole sequence. Null and empty texts and those
    of white space have no shingles and link with nothing. Rows that repeat an id are linked each by its own text.
    A row with a null id has a null component unless its text has a class with another id. Columns beside id and text are ignored.
    """
    got = _grouped(docs, id_col, text_col, threshold, k, margin)
    return got.select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("first._id", "_id").alias("component_id"))


def keep_one_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, k: int = 5, margin: float = 0.15) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near-duplicates, the one with the smallest id.

    All columns stay as they are. Of rows with the same id and text one stays, whatever their other columns; texts that share an
    id are documents of their own. Rows with a null id and texts without words all stay.
    """
    kept = _grouped(docs, id_col, text_col, threshold, k, margin).where("first = struct(_id, text_hash)").select("_id", "text_hash").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    rows = rows.select("_row", F.col(f"_row.`{id_col}`").cast("long").alias("_id"), F.col(f"_row.`{text_col}`").cast("string").alias("_text"))
    alone = F.col("_id").isNull() | ~F.coalesce(F.col("_text").rlike(WORD), F.lit(False))
    first = rows.where(~alone).withColumn("text_hash", F.xxhash64("_text")).join(kept.hint("merge"), ["_id", "text_hash"], "left_semi").dropDuplicates(["_id", "text_hash"])
    return first.select("_row").unionByName(rows.where(alone).select("_row")).select("_row.*")
