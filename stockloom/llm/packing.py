"""Packing token sequences of bounded length: Martello-Toth dominance reduction, then best fit.

Only lengths matter for packing, and there are at most ``capacity`` of them. So Spark counts the pieces of each
length, the plan is made on those counts (whole classes of pieces at a time, at any corpus size), and Spark hands out
the places: the rank of a piece among those of its length says which place of the plan it gets.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.text import chunks
from stockloom.llm.tokens import encoder
from stockloom.plans.durable import staged

Pattern = tuple[int, list[tuple[int, int]]]  # bins of this kind; (length, how many of it in a bin)


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Takes from ``counts`` the sets that dominate every other set with their largest piece, until there is none.

    For the largest piece j: alone if nothing fits beside it; with a piece that fills its bin exactly; with the largest
    fitting piece if no two pieces fit beside it; or, if no three do, when no two sum to more than that piece.
    """
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j] > 0:
                rest = capacity - j
                counts[j] -= 1  # the piece itself
                small = np.flatnonzero(counts[: rest + 1])
                counts[j] += 1
                if not len(small):
                    fixed.append((int(counts[j]), [(j, 1)]))
                    counts[j] = 0
                    changed = True
                    break
                best = int(small[-1])
                if best != rest:
                    low = [int(s) for s in small[:3] for _ in range(min(3, int(counts[s]) - (s == j)))][:3]
                    two = sum(low[:2]) if len(low) > 1 else rest + 1
                    three = sum(low) if len(low) > 2 else rest + 1
                    if two <= rest and (three <= rest or _best_pair(counts, small, rest, j) > best):
                        break
                many = int(counts[j]) // 2 if best == j else int(min(counts[j], counts[best]))
                fixed.append((many, [(j, 2)] if best == j else [(j, 1), (best, 1)]))
                counts[j] -= 2 * many if best == j else many
                if best != j:
                    counts[best] -= many
                changed = True
    return fixed


def _best_pair(counts: np.ndarray, small: np.ndarray, rest: int, j: int) -> int:
    """The largest sum up to ``rest`` of two pieces."""
    best, a, b = 0, 0, len(small) - 1
    while a <= b:
        x, y = int(small[a]), int(small[b])
        if x + y > rest:
            b -= 1
        else:
            if x != y or counts[x] - (x == j) > 1:
                best = max(best, x + y)
            a += 1
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: each length goes, as often as it fits, to the fullest bins with room."""
    room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(many: int, inside: list[tuple[int, int]], left: int) -> None:
        if left == 0:
            done.append((many, inside))
        elif many:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((many, inside))

    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            k = bisect_left(rooms, s)
            if k < len(rooms):
                left = rooms[k]
                bins, inside = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(k)
            else:
                left, inside = capacity, []
                bins = -(-n // (capacity // s))
            each = left // s
            full = min(bins, n // each)
            if full:
                put(full, [*inside, (s, each)], left - each * s)
            n -= full * each
            bins -= full
            if bins and n:
                put(1, [*inside, (s, n)], left - n * s)
                n, bins = 0, bins - 1
            if bins and inside:
                put(bins, inside, left)
    return done + [p for ps in room.values() for p in ps]


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """``(runs, bins)``: rows (length, first rank, pieces in a bin, first bin, offset), sorted by length and rank."""
    left = counts.copy()
    patterns = reduce_dominated(left, capacity)
    patterns += best_fit(left, capacity)
    rank: dict[int, int] = {}
    runs, base = [], 0
    for bins, inside in patterns:
        at = 0
        for length, each in inside:
            runs.append((length, rank.get(length, 0), each, base, at))
            rank[length] = rank.get(length, 0) + bins * each
            at += length * each
        base += bins
    runs.sort()
    return np.array(runs, np.int64).reshape(-1, 5), base


def cut_tokens(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is the ids of its whole text (null: none) and ``end_id``. Only longer ones are cut; their first piece may be
    shorter, the others are full. One row or more for each row of ``docs``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, last = encoder(tokenizer, False), np.uint32(end_id).tobytes()
        for part, raw in chunks(batches, 1, 3_000_000):
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(e.encode(raw)):
                ids += last
                n = len(ids) // 4
                many = -(-n // capacity)
                at = 0
                for k in range(many):
                    to = n - (many - 1 - k) * capacity
                    own = ids[4 * at : 4 * to]
                    owner.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        kept.append(own)
                    at = to
            cols = [part.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    schema = "_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def pack(pieces: DataFrame, capacity: int, order: list[str], length_col: str = "length", per_salt: int = 16_384) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with lengths from 1 to ``capacity``; every piece gets a place.

    ``order`` names columns that tell rows apart; equal rows are interchangeable. The pieces of one length are ranked in
    parts of about ``per_salt`` at most, as many as all pieces would fill, so that no common length is one task at any size.
    Reads ``pieces`` four times: pass a written table. An empty table stays empty.
    """
    salts = -(-max(pieces.count(), 1) // per_salt)
    cell = [F.col(length_col), F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int").alias("_salt")]
    sizes = pieces.groupBy(*cell).agg(F.count("*").alias("_n"))
    lengths = sizes.groupBy(length_col).agg(F.sum("_n").alias("n")).collect()  # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for r in lengths:
        if not 1 <= r[length_col] <= capacity:
            raise ValueError(f"a piece of length {r[length_col]} does not fit in {capacity}")
        counts[r[length_col]] = r["n"]
    runs, _ = plan(counts, capacity)
    before = Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(length_col), "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    salted = pieces.withColumn("_salt", cell[1])
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(starts, [length_col, "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")
    shared = pieces.sparkSession.sparkContext.broadcast(runs)  # some rows for each of the capacity lengths

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        r, n, k = shared.value, length.to_numpy(), rank.to_numpy()
        at = np.searchsorted((r[:, 0] << 44) + r[:, 1], (n << 44) + k, "right") - 1
        nth = k - r[at, 1]
        return pd.DataFrame({"sequence_id": r[at, 3] + nth // r[at, 2], "offset": r[at, 4] + nth % r[at, 2] * n})

    placed = ranked.withColumn("_p", place(F.col(length_col), F.col("_rank")))
    return placed.select(*pieces.columns, F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cuts, counts and packs whole documents; see ``cut_tokens`` and ``pack``. Tokenises once."""
    pieces = staged(cut_tokens(docs, tokenizer, capacity, id_col, text_col, with_ids=with_ids), "pieces")
    return pack(pieces, capacity, [id_col, "piece", "ids_crc32"])
