"""When a walk commits a view: a search for the next event on arrays of frames.

Between two commits everything that decides is a sum or an extreme over frames: how far the view has turned since the last commit, how
far it has advanced since the last keyframe, since when it has been steady. ``Trigger.take`` gets any number of frames of a
walk as columns, takes their running sums once, and looks for the next event block by block; what it keeps between calls are
offsets of those sums, the sharpest candidate and the frames of the hold that is still open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-6
BLOCK = 256
COMMIT_SCHEMA = "walk_id long, n long, t double, hold_from double, frame long, t_key double, step_deg double, no_hold boolean"
FRAME_COLUMNS = ["frame", "t", "speed", "dx", "dy", "lost", "sharp"]


def _first(mask: np.ndarray) -> int | None:
    at = int(mask.argmax()) if len(mask) else 0
    return at if len(mask) and mask[at] else None


@dataclass
class Candidate:
    """A frame that may become the keyframe, and how far the view had advanced there."""

    sharp: float
    frame: int
    t: float
    advance: np.ndarray


class Trigger:
    """The commit rule of a walk. Exactly one is the main one: ``hold`` (steady for so long; once a view is committed, it has to turn by
    ``rearm`` degrees, or tracking to be lost, before the next), ``every`` (the sharpest frame since the last commit, after so
    long) or ``sweep`` (each time the view has advanced by that share). ``fallback`` adds the sweep rule to ``hold`` for views
    passed without a pause.
    """

    def __init__(self, hold: float = 0.8, limit: float = 10.0, rearm: float = 5.0, every: float | None = None, sweep: float | None = None, sweep_speed: float | None = None,
                 fallback: float | None = None, focal: float = 500.0, width: float = 640.0, height: float = 480.0):
        if every is not None and sweep is not None or fallback is not None and (every is not None or sweep is not None):
            raise ValueError("every, sweep and fallback exclude each other")
        self.hold, self.limit, self.rearm, self.every, self.sweep, self.fallback = hold, limit, rearm, every, sweep, fallback
        self.slow = np.inf if sweep_speed is None else sweep_speed
        self.focal, self.view = focal, np.array([[width], [height]])
        self.commits, self.armed, self.astray = 0, True, False
        self.turn, self.shift = np.zeros((2, 1)), np.zeros((2, 1))  # to be added to the sums of the frames to come
        self.opened: float | None = None  # where the span of a timed or sweeping commit began
        self.since: float | None = None  # where the open hold began
        self.tail = {c: np.empty(0) for c in ("t", "frame", "sharp")}
        self.best: Candidate | None = None

    # -- what is known of a stretch of frames -----------------------------------------------------------------------------

    def _load(self, f: dict[str, np.ndarray], frame_time: float) -> None:
        self.t, self.sharp, self.frame, self.lost = f["t"], f["sharp"], f["frame"], f["lost"].astype(bool)
        gone = self.lost.copy()
        still = gone.copy()
        if self.opened is None:  # nothing is known about the step to the first frame
            self.opened, gone[0], still[0] = self.t[0] - frame_time, False, True
        self.path = np.cumsum(np.where(still, 0.0, np.stack([f["dx"], f["dy"]])), axis=1)
        self.gone = np.cumsum(gone)
        self.gone_before = -1 if self.astray else 0
        self.steady, self.crawls = f["speed"] < self.limit, (f["speed"] < self.slow) | np.isinf(self.slow)
        begins = self.steady & ~np.concatenate([[self.since is not None], self.steady[:-1]])
        self.run = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), -1))  # first frame of the run; -1: before these frames
        self.rearmed = -1
        self.all = {c: np.concatenate([self.tail[c], f[c]]) for c in self.tail}

    def _unload(self) -> None:
        last, before = len(self.t) - 1, len(self.tail["t"])
        start = max(self.run[last], self.rearmed)
        self.turn, self.shift = self.turn + self.path[:, -1:], self.shift + self.path[:, -1:]
        self.astray = bool(self.gone[last] > self.gone_before)
        keep = before + len(self.t)
        if self.steady[last]:
            self.since = float(self.t[start]) if start >= 0 else self.since
            keep = max(before + start if start >= 0 else 0, int(np.searchsorted(self.all["t"], self.t[last] - self.hold)))
        else:
            self.since = None
        self.tail = {c: v[keep:].copy() for c, v in self.all.items()}
        for c in ("t", "sharp", "frame", "lost", "path", "gone", "steady", "crawls", "run", "all"):
            delattr(self, c)

    def _turned(self, s: slice) -> np.ndarray:
        return np.degrees(np.arctan(np.hypot(*(self.path[:, s] + self.turn)) / self.focal))

    def _held_since(self, s: slice, rearmed: int) -> np.ndarray:
        """When the hold of each steady frame began: with its run, or where the rule was armed again within it."""
        start = np.maximum(self.run[s], rearmed)
        return np.where(start >= 0, self.t[start], np.nan if self.since is None else self.since)

    # -- the next event of a block ----------------------------------------------------------------------------------------

    def _sharper(self, lo: int, own: np.ndarray) -> None:
        """The sharpest of the marked frames from ``lo`` on becomes the candidate, unless the present one is as sharp."""
        if own.any():
            k = lo + int(np.where(own, self.sharp[lo : lo + len(own)], -np.inf).argmax())
            if self.best is None or self.sharp[k] > self.best.sharp:
                self.best = Candidate(float(self.sharp[k]), int(self.frame[k]), float(self.t[k]), self.path[:, k : k + 1] + self.shift)

    def _passed(self, lo: int, hi: int, goal: float, span: float, ready: np.ndarray) -> tuple[int | None, np.ndarray]:
        """Where the view has advanced to the goal with a candidate from the second half of the span; and the candidates."""
        left = np.clip(1 - np.abs(self.path[:, lo:hi] + self.shift) / self.view, 0, None)
        ahead = 1 - left[0] * left[1]
        fit = (ahead >= goal - span / 2) & self.crawls[lo:hi]
        return _first((ahead >= goal) & ready & (np.logical_or.accumulate(fit) | (self.best is not None))), fit

    def _take_best(self) -> Candidate:
        due, self.best = self.best, None
        self.shift = self.shift - due.advance
        return due

    def _timed(self, lo: int, hi: int) -> tuple | None:
        at = _first(self.t[lo:hi] - self.opened >= self.every - EPS)
        self._sharper(lo, np.ones(hi - lo if at is None else at + 1, bool))
        if at is None:
            return None
        due, begun, self.best, self.opened = self.best, self.opened, None, float(self.t[lo + at])
        return lo + at, due.frame, due.t, begun, False

    def _sweeping(self, lo: int, hi: int) -> tuple | None:
        at, fit = self._passed(lo, hi, self.sweep if self.commits else self.sweep / 2, self.sweep, np.ones(hi - lo, bool))
        self._sharper(lo, fit if at is None else fit[: at + 1])
        if at is None:
            return None
        due, begun = self._take_best(), self.opened
        self.opened = due.t
        return lo + at, due.frame, due.t, begun, False

    def _holding(self, lo: int, hi: int) -> tuple | None:
        s = slice(lo, hi)
        again = None if self.armed else _first(self.lost[s] | (self._turned(s) >= self.rearm))
        rearmed = self.rearmed if again is None else lo + again
        open_ = np.full(hi - lo, self.armed)
        if again is not None:
            open_[again:] = True
        since = self._held_since(s, rearmed)
        held = _first(self.steady[s] & open_ & (self.t[s] - since >= self.hold - EPS))
        passed = fit = None
        if self.fallback is not None:
            passed, fit = self._passed(lo, hi, self.fallback, self.fallback, ~self.steady[s])
        if passed is not None and (held is None or passed < held):
            if again is not None and again <= passed:
                self.armed, self.rearmed = True, rearmed
            self._sharper(lo, fit[: passed + 1])
            due = self._take_best()
            return lo + passed, due.frame, due.t, due.t, True
        if again is not None:
            self.armed, self.rearmed = True, rearmed
        if held is None:
            if fit is not None:
                self._sharper(lo, fit)
            return None
        at, before = lo + held, len(self.tail["t"])
        start = max(self.run[at], self.rearmed)
        low = max(before + start if start >= 0 else 0, int(np.searchsorted(self.all["t"], self.t[at] - self.hold)))
        k = low + int(self.all["sharp"][low : before + at + 1].argmax())
        self.armed, self.best, self.shift = False, None, -self.path[:, at : at + 1]
        return at, int(self.all["frame"][k]), float(self.all["t"][k]), float(since[held]), False

    def take(self, frames: dict[str, np.ndarray], frame_time: float) -> list[dict]:
        """The commits within the next frames of the walk, given in order: frame, t, speed (inf if unknown), dx, dy, lost, sharp."""
        if not len(frames["t"]):
            return []
        self._load(frames, frame_time)
        search = self._timed if self.every is not None else self._sweeping if self.sweep is not None else self._holding
        lo, size, out = 0, BLOCK, []
        while lo < len(self.t):
            hi = min(lo + size, len(self.t))
            event = search(lo, hi)
            if event is None:
                lo, size = hi, 2 * size
                continue
            at, frame, t_key, begun, unheld = event
            self.commits += 1
            known = self.commits > 1 and self.gone[at] == max(self.gone_before, 0) and self.gone_before >= 0
            step = float(self._turned(slice(at, at + 1))[0]) if known else None
            out.append({"n": self.commits, "t": float(self.t[at]), "hold_from": begun, "frame": frame, "t_key": t_key, "step_deg": step, "no_hold": unheld})
            self.turn, self.gone_before = -self.path[:, at : at + 1], int(self.gone[at])
            lo, size = at + 1, BLOCK
        self._unload()
        return out


def run_trigger(rows: pd.DataFrame, frame_time: float, options: dict, trigger: Trigger | None = None) -> list[dict]:
    """The commits of one walk's frames, sorted here by time and frame."""
    ordered = rows.sort_values(["t", "frame"])
    return (trigger or Trigger(**options)).take({c: ordered[c].to_numpy() for c in FRAME_COLUMNS}, frame_time)


def trigger_commits(frames: DataFrame, frame_time: float, **options) -> DataFrame:
    """The commits of each walk; frames has walk_id, frame, t, speed, dx, dy, lost, sharp. A pending commit is not flushed.

    Frames are dealt by walk and sorted by Spark; a walk goes through the search batch by batch, so that memory does not follow it.
    """
    Trigger(**options)  # reject conflicting options on the driver
    names = [c.split()[0] for c in COMMIT_SCHEMA.split(", ")]
    kinds = pa.schema([(n, pa.bool_() if n == "no_hold" else pa.int64() if n in ("walk_id", "n", "frame") else pa.float64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, machine = object(), None
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            cols = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in FRAME_COLUMNS}
            cut, found = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])).tolist() if len(ids) else [], []
            for i, j in zip(cut, [*cut[1:], len(ids)], strict=False):
                if ids[i] != walk:
                    walk, machine = ids[i], Trigger(**options)
                found += [{"walk_id": int(walk), **c} for c in machine.take({c: v[i:j] for c, v in cols.items()}, frame_time)]
            yield pa.RecordBatch.from_pylist(found, kinds)

    rows = frames.select(F.col("walk_id").cast("long"), F.col("frame").cast("long"), *(F.col(c).cast("double") for c in ("t", "speed", "dx", "dy")), "lost", F.col("sharp").cast("double"))
    return rows.repartition("walk_id").sortWithinPartitions("walk_id", "t", "frame").mapInArrow(run, COMMIT_SCHEMA)
