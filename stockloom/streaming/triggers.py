"""Structured Streaming: the commit trigger as keyed state, event-time windows, and an idempotent sink."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stockloom.operators.commits import COMMIT_SCHEMA, FRAME_COLUMNS, Trigger

WALKS = 16


def stream_commits(frames: DataFrame, frame_time: float, expire: str = "1 day", late: str = "0 seconds", **options) -> DataFrame:
    """The commits of each walk of a stream of frames: the batch fold with its state kept between micro-batches.

    Frames of a walk must arrive in time order across batches; inside a batch they are sorted. A pending commit is not
    flushed at the end. Frames have their event time in ``ts``: a walk's state is dropped once the watermark is ``expire`` past its
    last frame, so that state does not grow with all walks ever seen; a later frame begins the walk anew.
    Up to ``WALKS`` walks with neighbouring ids share a call and an entry of the state, which has each walk's machine and when it is due.
    """
    Trigger(**options)
    span = int(pd.Timedelta(expire).total_seconds() * 1000)
    names = [c.split()[0] for c in COMMIT_SCHEMA.split(", ")]

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machines, mark, met, found = pickle.loads(state.get[0]) if state.exists else {}, state.getCurrentWatermarkMs(), set(), []
        if not state.hasTimedOut:
            rows = pd.concat(list(pdfs)).sort_values(["walk_id", "t", "frame"])
            ids, last = rows["walk_id"].to_numpy(), rows["ms"].to_numpy(float)
            cols = {c: rows[c].to_numpy() for c in FRAME_COLUMNS}
            cut = [0] if pd.isna(key[0]) else np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])).tolist()
            for i, j in zip(cut, [*cut[1:], len(ids)], strict=True):
                walk = None if pd.isna(key[0]) else int(ids[i])
                machine = machines[walk][0] if walk in machines else Trigger(**options)
                found += [{"walk_id": walk, **c} for c in machine.take({c: v[i:j] for c, v in cols.items()}, frame_time)]
                machines[walk] = machine, int(np.fmax.reduce(last[i:j], initial=mark)) + span
                met.add(walk)
        machines = {walk: held for walk, held in machines.items() if walk in met or held[1] >= mark}
        if machines:
            state.update((pickle.dumps(machines),))
            state.setTimeoutTimestamp(min(due for _, due in machines.values()))
        else:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=names)

    rows = frames.withWatermark("ts", late).select(F.expr(f"walk_id div {WALKS}").alias("walks"), "walk_id", "ts", F.unix_millis("ts").alias("ms"), *FRAME_COLUMNS)
    return rows.groupBy("walks").applyInPandasWithState(step, COMMIT_SCHEMA, "machines binary", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(frames: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Frames and lost frames of each window of event time; ``ts`` is cast from a zone-less time, late rows are dropped after ``late``."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(window.alias("w"), "kind").agg(F.count("*").alias("frames"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "frames", F.round("total", 4).alias("total"))


def steady_sessions(frames: DataFrame, gap: str, limit: float, late: str = "1 hour") -> DataFrame:
    """Sessions of steady frames: filtered first, then closed by a gap of event time."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where(F.col("value") < limit)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("frames")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "frames")


def exactly_once(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch replaces its own folder, so that a repeated batch writes the same rows once."""

    def write(df: DataFrame, batch: int) -> None:
        df.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def first_in_time(rows: DataFrame, key: str, late: str) -> DataFrame:
    """The first row of each key of a stream with event time ``ts``; rows behind the watermark are dropped, and keys older than it are forgotten."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def dropped(fed: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Every key of ``fed`` with its columns, how often it was fed, and whether any of it is in ``kept``."""
    others = [c for c in fed.columns if c != key]
    once = fed.groupBy(key).agg(F.count("*").alias("fed"), *(F.first(c).alias(c) for c in others))
    return once.join(kept.select(key).distinct().withColumn("kept", F.lit(True)), key, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def limited(spark: SparkSession, schema, path: str, files: int | None = None, size: str | None = None) -> DataFrame:
    """A stream of Parquet files that takes at most so many files, or bytes, a batch, so that a backlog is worked off at a steady rate."""
    reader = spark.readStream.schema(schema)
    for option, value in (("maxFilesPerTrigger", files), ("maxBytesPerTrigger", size)):
        reader = reader.option(option, value) if value else reader
    return reader.parquet(path)


def taken(query) -> list[tuple[int, int]]:
    """``(batch, rows)`` of the batches of a query that took rows, as far as its progress is kept."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]


def whole_result(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for complete results: each batch writes its own folder, once."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def last_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the last batch of ``whole_result`` wrote."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == F.lit(last)).drop("batch")
