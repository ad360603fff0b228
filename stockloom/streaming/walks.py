"""Counting walks as a stream: what neighbouring walks have counted is keyed state, a map entry for a few commits of theirs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stockloom.functions import geometry as g
from stockloom.functions.transforms import in_frames, moved_boxes
from stockloom.operators.counting import BOX, STATUS_SCHEMA, _starts, spread, view_matches
from stockloom.operators.detections import status as view_place

_SEEN = "walk binary, n binary, item binary, at binary, kind binary, names array<string>, box binary"
_COMMIT = ["walk_id", "n", "ms", "det_id", "cls", "place", *BOX, "a", "inliers", "h"]
_OUT = Row(*(c.split()[0] for c in STATUS_SCHEMA.split(", ")))
CHUNK, WALKS = 16, 256  # commits and walks an entry
NO_WALK = -(2**63)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def commit_rows(dets: DataFrame, links: DataFrame, threshold: float, width: float, height: float, margin: float, band: float) -> DataFrame:
    """One row for each commit: walk_id, n, ts, its placed detections and the links to it. dets has ts; else as in ``count_commits``."""
    place = view_place(F.col("score"), g.box(), threshold, width, height, margin, band)
    own = dets.groupBy(F.col("walk_id").cast("long").alias("walk_id"), F.col("n").cast("long").alias("n"), "ts").agg(F.sort_array(F.collect_list(F.struct(F.col("det_id").cast("long").alias("det_id"), F.col("cls").cast("string").alias("cls"), place.alias("place"), *(F.col(c).cast("double").alias(c) for c in BOX)))).alias("dets"))
    to = links.groupBy(F.col("walk_id").cast("long").alias("walk_id"), F.col("b").cast("long").alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.col("a").cast("long").alias("a"), F.col("inliers").cast("long").alias("inliers"), F.col("h").cast("array<double>").alias("h")))).alias("links"))
    return own.join(to, ["walk_id", "n"], "left")


class Seen:
    """The items that a few commits have seen, as columns: walk, commit, item, when it was written, class (-1: none) and box."""

    def __init__(self, row: tuple | None = None, since: int = -1):
        self.cols = [np.frombuffer(b"" if row is None else row[i], np.int64) for i in range(5)] + [np.frombuffer(b"" if row is None else row[6]).reshape(-1, 4)]
        self.names = [] if row is None else list(row[5])
        self.keep(self.cols[3] > since)

    def keep(self, which: np.ndarray) -> None:
        self.cols = [c[which] for c in self.cols]

    def kinds(self) -> np.ndarray:
        return np.array([*self.names, None], object)[self.cols[4]]

    def add(self, walk: np.ndarray, n: np.ndarray, item: np.ndarray, at: int, kind: np.ndarray, box: np.ndarray) -> None:
        code, names = pd.factorize(np.concatenate([self.kinds(), kind]))
        self.names, m = names.tolist(), len(self.cols[0])
        self.cols[4] = code[:m]
        self.cols = [np.concatenate([old, new]) for old, new in zip(self.cols, (walk, n, item, np.full(len(n), at), code[m:], box), strict=True)]

    def row(self) -> tuple:
        *ints, box = self.cols
        return (*(np.asarray(v, np.int64).tobytes() for v in ints), self.names, np.asarray(box, float).tobytes())


class WalkCounter(StatefulProcessor):
    """Items seen in each commit (map state, ``CHUNK`` commits of the walks of a key an entry, with a time to live) and when each walk is due (value state).

    A batch reads each entry that its commits are linked with once and writes each that it adds to once: what a call to the
    state costs follows neither commits nor walks. Commits of different walks are counted side by side, those of a walk one after the other.
    Nor does a commit move a timer: it fires when the first walk was due, drops those that are, and is set again for the others.
    """

    def __init__(self, width: float, height: float, band: float, expire_ms: int, keep_ms: int | None):
        self.frame = np.array([[band, width - band, width - band, band], [band, band, height - band, height - band]])
        self.expire, self.keep = expire_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "chunk bigint", _SEEN, ttlDurationMs=self.keep)
        self.due = handle.getValueState("due", "walk binary, due binary, timer bigint")

    def _counted(self, rows: pd.DataFrame, timerValues) -> pd.DataFrame:
        at = timerValues.getCurrentProcessingTimeInMs() if self.keep else 0
        rows = rows.sort_values(["walk_id", "n"], kind="stable", ignore_index=True)
        walk, n, ms = (rows[c].to_numpy(np.int64) for c in ("walk_id", "n", "ms"))
        first = _starts(walk)
        rank = np.arange(len(walk)) - np.repeat(first, np.diff(np.append(first, len(walk))))
        tied = rows[[x is not None for x in rows["a"]]]
        flat = lambda part, c, kind: np.concatenate([np.zeros(0, kind), *(np.asarray(x, kind).ravel() for x in part[c])])
        d_many, l_many = np.array([len(x) for x in rows["det_id"]], int), np.zeros(len(n), int)
        l_many[tied.index] = [len(x) for x in tied["a"]]
        d_low, l_low = np.cumsum(d_many) - d_many, np.cumsum(l_many) - l_many
        of, l_of = np.repeat(np.arange(len(n)), d_many), np.repeat(np.arange(len(n)), l_many)
        det_id, cls, place, box = flat(rows, "det_id", np.int64), flat(rows, "cls", object), flat(rows, "place", object), np.stack([flat(rows, c, float) for c in BOX], 1)
        a, inliers, h = flat(tied, "a", np.int64), flat(tied, "inliers", np.int64), flat(tied, "h", float).reshape(-1, 9)
        asked = in_frames(self.frame, h, box, *spread(l_low[of], l_many[of]))
        inner = place == "inner"
        live, owner, gained = inner | (place == "band"), np.full(len(of), -1), np.zeros(len(of), bool)

        held = {c: self._entry(c, at) for c in np.unique(a // CHUNK).tolist()}
        old = [np.concatenate(x) for x in zip(*([*e.cols[:3], e.kinds(), e.cols[5]] for e in held.values()), strict=True)] if held else [walk[:0]] * 3 + [cls[:0], box[:0]]
        order = np.lexsort((old[1], old[0]))
        w, k, item, kind, there = (x[order[np.isin(old[0][order], walk)]] for x in old)
        # Places in the columns item, kind and there: what the state has by walk and commit, then what each step adds.
        code = pd.factorize(np.concatenate([kind, cls]))[0]
        cut, free = _starts(w, k), len(w)
        numbers, walks = np.unique(np.concatenate([k, n])), np.unique(walk)
        key = lambda w, k: np.searchsorted(walks, w) * (len(numbers) + 1) + np.where(np.isin(k, numbers), np.searchsorted(numbers, k), len(numbers))
        keys = np.concatenate([key(w[cut], k[cut]), key(walk, n)])
        order = np.argsort(keys, kind="stable")
        place_of = np.argsort(order)[len(cut) :]  # of each commit
        low, many = (np.concatenate([x, np.zeros(len(n), int)])[order] for x in (cut, np.diff(np.append(cut, len(w)))))
        l_from, l_to = (np.searchsorted(keys[order], key(walk[l_of], a), side) for side in ("left", "right"))
        item, there = np.concatenate([item, np.zeros(len(of), int)]), np.concatenate([there, np.zeros((len(of), 4))])
        kind, own_kind = np.concatenate([code[:free], np.zeros(len(of), int)]), code[free:]
        strong = np.empty(len(a), int)
        strong[np.lexsort((np.arange(len(a)), -a, -inliers, l_of))] = np.arange(len(a))  # most inliers first, the later of equals
        by_rank = np.argsort(rank, kind="stable")
        for c in np.split(by_rank, np.searchsorted(rank[by_rank], np.arange(1, int(rank.max()) + 1))):
            view, d = spread(d_low[c], d_many[c])
            lv, link = spread(l_low[c], l_many[c])
            x, y = spread(l_from[link], (l_to - l_from)[link])
            z, row = spread(low[y], many[y])
            link, lv = link[x[z]], lv[x[z]]
            best = np.lexsort((row, strong[link], item[row], lv))
            best = best[_starts(lv[best], item[row[best]])]
            on = live[d]
            if len(best) and on.any():
                link, lv, row = link[best], lv[best], row[best]
                i, j = view_matches(box[d[on]], own_kind[d[on]], moved_boxes(h[link].T, there[row]), kind[row], view[on], lv)
                owner[d[on][i]] = item[row[j]]
            got = on & ((owner[d] >= 0) | (inner[d] & ~asked[d]))
            view, d = view[got], d[got]
            gained[d] = True
            owner[d] = np.where(owner[d] >= 0, owner[d], (n[of[d]] << 32) + det_id[d])
            end = free + len(d)
            item[free:end], kind[free:end], there[free:end] = owner[d], own_kind[d], box[d]
            added = np.bincount(view, minlength=len(c))
            low[place_of[c]], many[place_of[c]], free = free + np.cumsum(added) - added, added, end
        self._kept(held, at, walk[of[gained]], n[of[gained]], owner[gained], cls[gained], box[gained])
        self._due(walks, np.maximum(np.maximum.reduceat(ms, first) + self.expire, timerValues.getCurrentWatermarkInMs() + 1))
        fresh = gained & (owner == (n[of] << 32) + det_id)
        status = np.where(live, np.select([fresh, gained, asked], ["new", "seen", "miss"], "edge").astype(object), place)
        return pd.DataFrame({"walk_id": walk[of], "n": n[of], "det_id": det_id, "cls": cls, "status": status})

    def _entry(self, chunk: int, at: int) -> Seen:
        return Seen(self.seen.getValue((chunk,)), at - self.keep if self.keep else -1)

    def _kept(self, held: dict[int, Seen], at: int, walk: np.ndarray, n: np.ndarray, item: np.ndarray, kind: np.ndarray, box: np.ndarray) -> None:
        for chunk in np.unique(n // CHUNK).tolist():
            own, e = n // CHUNK == chunk, held[chunk] if chunk in held else self._entry(chunk, at)
            e.add(walk[own], n[own], item[own], at, kind[own], box[own])
            self.seen.updateValue((chunk,), e.row())

    def _due(self, walks: np.ndarray, due: np.ndarray) -> None:
        was = self.due.get()
        dues = (dict(zip(*(np.frombuffer(x, np.int64).tolist() for x in was[:2]), strict=True)) if was else {}) | dict(zip(walks.tolist(), due.tolist(), strict=True))
        self._set(dues, was[2] if was else None)

    def _set(self, dues: dict[int, int], timer: int | None) -> None:
        if timer is None or min(dues.values()) < timer:
            timer = min(dues.values())
            self.handle.registerTimer(timer)
        self.due.update((*(np.array(list(x), np.int64).tobytes() for x in (dues, dues.values())), timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        got = self._counted(pd.DataFrame([tuple(r) for r in rows], columns=_COMMIT), timerValues)
        return iter([_OUT(*r) for r in got.itertuples(index=False)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        was, mark = self.due.get(), timerValues.getCurrentWatermarkInMs()
        walk, due = (np.frombuffer(x, np.int64) for x in was[:2]) if was else (np.zeros(0, np.int64),) * 2
        left = due > mark
        if not left.any():
            self.seen.clear()
            self.due.clear()
            return iter([])
        for chunk, row in [] if left.all() else list(self.seen.iterator()):
            e = Seen(row)
            some = np.isin(e.cols[0], walk[left])
            e.keep(some)
            if not some.any():
                self.seen.removeKey(chunk)
            elif not some.all():
                self.seen.updateValue(chunk, e.row())
        self._set(dict(zip(walk[left].tolist(), due[left].tolist(), strict=True)), None)
        return iter([])

    def close(self) -> None:
        pass


class FrameCounter(WalkCounter):
    """The same on data frames, the columns of many walks' commits at once. Walks without an id are one walk, with a key of its own."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = self._counted(pd.concat(list(rows), ignore_index=True), timerValues)
        yield got.assign(walk_id=None) if key[0] == NO_WALK else got


def stream_statuses(commits: DataFrame, width: float, height: float, band: float, expire: str = "30 days", keep: str | None = None, late: str = "0 seconds") -> DataFrame:
    """The statuses of a stream of commits (rows of ``commit_rows``): those of ``count_commits`` without motion.

    Commits of a walk come in order of their number, those of one batch in any. A walk's state is dropped once the watermark is ``expire`` past its
    last commit; ``keep`` drops what a commit has seen after so much processing time. Up to ``WALKS`` walks with neighbouring ids share a
    call and the entries of the state. Sets the state store to RocksDB, which keyed maps need.
    """
    spark = commits.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ms = lambda d: int(pd.Timedelta(d).total_seconds() * 1000)
    counter = FrameCounter(width, height, band, ms(expire), ms(keep) if keep else None)
    of = lambda rows, *fields: [F.col(f"{rows}.{f}").alias(f) for f in fields]
    walks = F.coalesce(F.expr(f"walk_id div {WALKS}"), F.lit(NO_WALK)).alias("walks")
    rows = commits.withWatermark("ts", late).select(walks, F.coalesce("walk_id", F.lit(0)).alias("walk_id"), "n", F.unix_millis("ts").alias("ms"), *of("dets", "det_id", "cls", "place", *BOX), *of("links", "a", "inliers"), F.flatten("links.h").alias("h"))
    return rows.groupBy("walks").transformWithStateInPandas(counter, STATUS_SCHEMA, "Append", "EventTime")
