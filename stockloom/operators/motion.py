"""Windows over a walk's frames: speed, holds, gaps, flags. All windows are partitioned by walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_frame() -> WindowSpec:
    """A walk's frames in order; made on call, because a window needs a session."""
    return Window.partitionBy("walk_id").orderBy("frame")


def steps(frames: DataFrame, focal: float, frame_time: float) -> DataFrame:
    """Adds ``dt`` (the clock's step; a frame's time where it did not advance), ``angle`` and ``deg_s``.

    The first frame of a walk and frames with lost tracking have no displacement: their speed is infinite.
    """
    dt = F.col("t") - F.lag("t").over(by_frame())
    first = F.lag("t").over(by_frame()).isNull()
    step = F.when(dt > 0, dt).otherwise(F.lit(frame_time))
    px = F.when(first | F.col("lost"), F.lit(None)).otherwise(F.col("px"))
    angle = F.degrees(F.atan(px / focal))
    return frames.withColumn("dt", step).withColumn("angle", angle).withColumn("deg_s", F.coalesce(angle / step, F.lit(float("inf"))))


def rolling_median(col: str, rows: int) -> Column:
    """Median over the last ``rows`` frames with the current one; shorter at the start."""
    return F.percentile(col, 0.5).over(by_frame().rowsBetween(1 - rows, 0))


def holds(frames: DataFrame, limit: float, rows: int = 3) -> DataFrame:
    """Maximal runs of frames with a median speed under ``limit``: walk_id, hold, t_from, t_to, frames."""
    med = frames.withColumn("_med", rolling_median("speed", rows)).withColumn("_steady", F.col("_med") < limit)
    turn = F.when(F.col("_steady") != F.coalesce(F.lag("_steady").over(by_frame()), ~F.col("_steady")), 1).otherwise(0)
    runs = med.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(by_frame())).where("_steady")
    out = runs.groupBy("walk_id", "_run").agg(F.min("t").alias("t_from"), F.max("t").alias("t_to"), F.count("*").alias("frames"))
    return out.select("walk_id", F.row_number().over(Window.partitionBy("walk_id").orderBy("t_from")).cast("long").alias("hold"), "t_from", "t_to", "frames")


def simple_trigger(frames: DataFrame, limit: float, hold: float, rows: int = 3) -> DataFrame:
    """The first frame of each steady run that has been steady for ``hold``, without the re-arm rule: pure windows."""
    med = frames.withColumn("_steady", rolling_median("speed", rows) < limit)
    turn = F.when(F.col("_steady") != F.coalesce(F.lag("_steady").over(by_frame()), ~F.col("_steady")), 1).otherwise(0)
    runs = med.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(by_frame())).where("_steady")
    in_run = Window.partitionBy("walk_id", "_run").orderBy("frame")
    late = runs.withColumn("_from", F.min("t").over(in_run)).where(F.col("t") - F.col("_from") >= hold - 1e-6)
    return late.groupBy("walk_id", "_run").agg(F.min(F.struct("frame", "t", "_from")).alias("f")).select("walk_id", F.col("f.frame").alias("frame"), F.col("f.t").alias("t"), F.col("f._from").alias("hold_from"))


def sharpest_in_window(frames: DataFrame, hold: float, sharp: str) -> DataFrame:
    """For each frame the sharpest of the trailing ``hold``, the earliest of equals."""
    span = f"OVER (PARTITION BY walk_id ORDER BY t RANGE BETWEEN {float(hold)}D PRECEDING AND CURRENT ROW)"
    return frames.withColumn("key_frame", F.expr(f"max_by(frame, struct({sharp}, -frame)) {span}"))


def gaps(commits: DataFrame) -> DataFrame:
    """Adds ``gap`` to the commit before (null for a walk's first)."""
    return commits.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("walk_id").orderBy("n")))


def gap_summary(commits: DataFrame, opened: Column, closed: Column) -> DataFrame:
    """Gaps of each walk's commits: the longest counts the time from ``opened`` to the first and from the last to ``closed`` too,
    the median only the gaps between commits (null for one commit)."""
    of = gaps(commits).groupBy("walk_id").agg(F.max("gap").alias("_inner"), F.median("gap").alias("median_gap"), F.count("*").alias("commits"), F.min("t").alias("_first"), F.max("t").alias("_last"), F.first(opened).alias("opened"), F.first(closed).alias("closed"))
    return of.select("walk_id", F.greatest("_inner", F.col("_first") - F.col("opened"), F.col("closed") - F.col("_last")).alias("max_gap"), "median_gap", "commits", (F.col("closed") - F.col("opened")).alias("length"))


def segments(frames: DataFrame, reset: Column) -> DataFrame:
    """Adds ``segment``: the number of resets so far; a reset's own frame opens the segment."""
    return frames.withColumn("segment", F.sum(reset.cast("int")).over(by_frame()).cast("long"))


def flags(commits: DataFrame, dark: float = 50.0, blurry: float = 0.35, glare: float = 0.02) -> DataFrame:
    """Adds ``flags``: dark under a grey level, blurry against the walk's median sharpness, glare over a clipped share."""
    median = F.median("sharp").over(Window.partitionBy("walk_id"))
    listed = F.array_compact(F.array(F.when(F.col("luma") < dark, F.lit("dark")), F.when(F.col("sharp") < blurry * median, F.lit("blurry")), F.when(F.col("clipped") > glare, F.lit("glare"))))
    return commits.withColumn("flags", listed)


def stable_candidates(hits: DataFrame, track: str, span: float, least: int) -> DataFrame:
    """Hits that are at least the ``least``-th of their track within the last ``span``."""
    n = F.expr(f"count(*) OVER (PARTITION BY {track} ORDER BY t RANGE BETWEEN {float(span)}D PRECEDING AND CURRENT ROW)")
    return hits.withColumn("hits", n).where(F.col("hits") >= least)


def dead_reckoned(frames: DataFrame, seen: Column, limit: float) -> DataFrame:
    """Adds ``carried``: seen now, or last seen no longer than ``limit`` ago."""
    last = F.last(F.when(seen, F.col("t")), ignorenulls=True).over(by_frame().rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("carried", F.coalesce(F.col("t") - last <= limit, F.lit(False)))


def leaky_walk(rows: DataFrame, key: str, order: str, noise: str, keep: float) -> DataFrame:
    """``x = keep * x + noise`` along each group, last value and number of steps; ``order`` counts a group's rows from 1.

    The last value is the sum of all noise, each times ``keep`` to the power of the steps since: one aggregate, whatever a walk's length.
    """
    since = F.max(order).over(Window.partitionBy(key)) - F.col(order)
    return rows.withColumn("_since", since).groupBy(key).agg(F.count("*").alias("steps"), F.sum(F.col(noise) * F.pow(F.lit(keep), "_since")).alias("x"))
