"""A walk counted by a plain fold over its commits, one walk at a time in memory: what the supersteps are held to."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from stockloom.operators.folds import assign

REACH, QUANTUM, LEAST, SHARE = 0.5, 2.0, 3, 0.25


def moved_points(h: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Points (n, k, 2) under a transform for each of the n."""
    out = np.einsum("nij,nkj->nki", h[:, :, :2], xy) + h[:, None, :, 2]
    return out[..., :2] / out[..., 2:]


def moved_boxes(h: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The hulls of boxes (n, 4) under a transform for each."""
    corners = moved_points(h, box[:, [[0, 1], [2, 1], [2, 3], [0, 3]]])
    return np.hstack([corners.min(1), corners.max(1)])


def in_any(quads: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Which points lie in one of the convex quads (n, 4, 2) or on its border."""
    side = np.roll(quads, -1, 1) - quads
    away = xy[:, None, None] - quads[None]
    turn = side[None, ..., 0] * away[..., 1] - side[None, ..., 1] * away[..., 0]
    return ((turn >= 0).all(2) | (turn <= 0).all(2)).any(1)


@dataclass
class Pairs:
    """Detections and carried items of one class that are near enough to matter: indices, difference, half box of the detection."""

    det: np.ndarray
    item: np.ndarray
    diff: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, box: np.ndarray, kind: np.ndarray, carried: np.ndarray, carried_kind: np.ndarray) -> Pairs:
        det, item = np.nonzero(kind[:, None] == carried_kind[None])
        mid = lambda b: (b[:, :2] + b[:, 2:]) / 2
        return cls(det, item, mid(carried)[item] - mid(box)[det], np.maximum(REACH * (box[det, 2:] - box[det, :2]), 1e-9))

    def distance(self, offset: np.ndarray) -> np.ndarray:
        """In half boxes, after the detections have moved by ``offset``."""
        return np.hypot(*((self.diff - offset) / self.half).T)

    def offset(self, box: np.ndarray) -> np.ndarray:
        """The move within half a median box that brings most detections to an item, the shortest of equals; none for too few.

        Each pair proposes its own difference, rounded to the grid; pairs are sorted by detection, so that a proposal's
        support is counted by runs.
        """
        limit = REACH * np.median(box[:, 2:] - box[:, :2], axis=0)
        own = self.diff[(np.abs(self.diff) <= limit).all(1)]
        proposals = np.unique(np.vstack([np.zeros((1, 2)), QUANTUM * np.round(own / QUANTUM)]) + 0.0, axis=0)
        starts = np.flatnonzero(np.diff(self.det, prepend=-1))
        support = np.array([np.logical_or.reduceat(self.distance(p) <= 1, starts).sum() for p in proposals])
        if support.max() < max(LEAST, SHARE * len(box)):
            return np.zeros(2)
        return np.array(min(proposals[support == support.max()].tolist(), key=lambda p: (math.hypot(*p), p)))

    def matches(self, offset: np.ndarray) -> list[tuple[int, int]]:
        """The cheapest one-to-one matches with a distance of 1 or less, found within each connected group of such pairs."""
        far = self.distance(np.asarray(offset))
        near = np.flatnonzero(far <= 1)
        group = {("d", d): k for k, d in enumerate(self.det[near])} | {("i", i): -1 - k for k, i in enumerate(self.item[near])}
        ends = [(("d", self.det[p]), ("i", self.item[p]), p) for p in near]
        changed = True
        while changed:  # labels sink to the smallest of the group
            changed = False
            for d, i, _ in ends:
                low = min(group[d], group[i])
                if group[d] != low or group[i] != low:
                    group[d] = group[i] = low
                    changed = True
        out = []
        for label in sorted({group[d] for d, _, _ in ends}):
            own = [p for d, _, p in ends if group[d] == label]
            dets, items = np.unique(self.det[own]), np.unique(self.item[own])
            cost = np.full((len(dets), len(items)), 1e3)
            cost[np.searchsorted(dets, self.det[own]), np.searchsorted(items, self.item[own])] = far[own]
            out += [(int(dets[a]), int(items[b])) for a, b in zip(*assign(cost), strict=True) if cost[a, b] <= 1]
        return out


def zone_transform(base: np.ndarray, now: np.ndarray) -> np.ndarray | None:
    """How a zone has moved, from the centres of its counted items then and now: a least-squares similarity from four of them
    if its scale is within (2/3, 1.5) and its rotation under 0.26 rad, else their median shift; None without any."""
    if not len(base):
        return None
    if len(base) >= 4:
        mid, to = base.mean(0), now.mean(0)
        p, q = base - mid, now - to
        size = (p**2).sum()
        if size > 0:
            a, b = (p * q).sum() / size, (p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum() / size
            if 2 / 3 < math.hypot(a, b) < 1.5 and abs(math.atan2(b, a)) < 0.26:
                r = np.array([[a, -b], [b, a]])
                return np.vstack([np.hstack([r, (to - r @ mid)[:, None]]), [0, 0, 1]])
    dx, dy = np.median(now - base, axis=0)
    return np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1.0]])


@dataclass
class Zone:
    """The inner frame of a view, and how it lies now: by the items counted there, else by the motion for a while."""

    n: int
    items: np.ndarray
    centres: np.ndarray
    t: float
    motion: np.ndarray = field(default_factory=lambda: np.eye(3))

    def follow(self, step: np.ndarray | None, boxes: np.ndarray, t: float, patience: float) -> np.ndarray | None:
        self.motion = self.motion if step is None else step @ self.motion
        here = ~np.isnan(boxes[self.items, 0])
        self.t = t if here.any() else self.t
        own = boxes[self.items[here]]
        h = zone_transform(self.centres[here], (own[:, :2] + own[:, 2:]) / 2)
        return self.motion if h is None and t - self.t <= patience else h


class Walk:
    """The items and zones of a walk; ``view`` takes the commits one after the other."""

    def __init__(self, width: float, height: float, band: float, tracked: bool, patience: float):
        self.size, self.tracked, self.patience = (width, height), tracked, patience
        self.frame = np.array([[band, band], [width - band, band], [width - band, height - band], [band, height - band]])
        self.kind = np.empty(0, object)
        self.box, self.t = np.empty((0, 4)), np.empty(0)  # where an item is now; NaN once it is lost
        self.seen = [np.empty(0, int), np.empty(0, int), np.empty((0, 4))]  # sightings: item, commit, box
        self.zones: list[Zone] = []

    def _track(self, step: np.ndarray | None, t: float) -> np.ndarray:
        """Moves items and zones with the view; the transforms of the zones that are still known, others are dropped."""
        if step is not None and len(self.box):
            self.box = moved_boxes(np.broadcast_to(step, (len(self.box), 3, 3)), self.box)
            mid = (self.box[:, :2] + self.box[:, 2:]) / 2
            inside = ((mid >= 0) & (mid < self.size)).all(1)
            self.t[inside] = t
        self.box[t - self.t > self.patience] = np.nan
        found = [(z, z.follow(step, self.box, t, self.patience)) for z in self.zones]
        self.zones = [z for z, h in found if h is not None]  # a lost zone comes back through a link only
        return np.array([h for _, h in found if h is not None]).reshape(-1, 3, 3)

    def _linked(self, links: dict[int, tuple[np.ndarray, int]], skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and their boxes in this view, each through the best-registered linked commit that saw it, the later of equals."""
        item, n, box = self.seen
        own = np.flatnonzero(np.isin(n, list(links)) & ~skip[item])
        power = np.array([links[k][1] for k in n[own].tolist()], float)
        own = own[np.lexsort((n[own], power, item[own]))]
        best = own[np.append(item[own][1:] != item[own][:-1], True)] if len(own) else own
        return item[best], moved_boxes(np.array([links[k][0] for k in n[best].tolist()]).reshape(-1, 3, 3), box[best])

    def view(self, n: int, t: float, box: np.ndarray, place: np.ndarray, kind: np.ndarray, links: dict[int, tuple[np.ndarray, int]], step: np.ndarray | None) -> np.ndarray:
        """The status of each detection of a commit: low and cut as they are, else seen, miss, new or edge. A miss is never
        stored, so that it prompts again in later views."""
        zones = self._track(step, t) if self.tracked else np.empty((0, 3, 3))
        known = {z.n for z in self.zones} if self.tracked else set()
        zones = np.concatenate([zones, np.array([h for k, (h, _) in links.items() if k not in known]).reshape(-1, 3, 3)])
        held = np.flatnonzero(~np.isnan(self.box[:, 0])) if self.tracked else np.empty(0, int)
        skip = np.zeros(len(self.kind), bool)
        skip[held] = True
        which, where = self._linked(links, skip)
        which, where = np.concatenate([held, which]), np.concatenate([self.box[held], where])
        out = place.copy()
        live = np.flatnonzero((place == "inner") | (place == "band"))
        mid = (box[live, :2] + box[live, 2:]) / 2
        owner = np.full(len(live), -1)
        pairs = Pairs.of(box[live], kind[live], where, self.kind[which])
        if len(pairs.det):
            for d, i in pairs.matches(pairs.offset(box[live])):
                owner[d] = which[i]
        asked = in_any(moved_points(zones, np.broadcast_to(self.frame, (len(zones), 4, 2))), mid) if len(zones) else np.zeros(len(live), bool)
        out[live] = np.select([owner >= 0, asked, place[live] == "inner"], ["seen", "miss", "new"], "edge")
        fresh = np.flatnonzero(out[live] == "new")
        owner[fresh] = len(self.kind) + np.arange(len(fresh))
        self.kind = np.concatenate([self.kind, kind[live[fresh]]])
        self.box, self.t = np.concatenate([self.box, np.empty((len(fresh), 4))]), np.concatenate([self.t, np.empty(len(fresh))])
        got = owner >= 0
        self.box[owner[got]], self.t[owner[got]] = box[live[got]], t
        self.seen = [np.concatenate(x) for x in zip(self.seen, (owner[got], np.full(got.sum(), n), box[live[got]]), strict=True)]
        self.zones.append(Zone(n, owner[got], mid[got], t))
        return out


def statuses(dets, links, width, height, band, motion=False, dead_reckon=3.0):
    """``{(walk, n, det_id): status}``; dets: pandas rows with place, links: pandas rows with h as nine numbers."""
    out = {}
    for walk_id, own in dets.groupby("walk_id"):
        tied: dict[int, dict] = {}
        for r in links[links.walk_id == walk_id].itertuples():
            tied.setdefault(int(r.b), {})[int(r.a)] = (np.array(r.h, float).reshape(3, 3), int(r.inliers))
        walk = Walk(width, height, band, motion, dead_reckon)
        for n, v in own.sort_values(["n", "det_id"]).groupby("n"):
            to = tied.get(n, {})
            got = walk.view(n, float(v.t.iloc[0]), v[["x0", "y0", "x1", "y1"]].to_numpy(float), v.place.to_numpy(object), v.cls.to_numpy(object), to, to[n - 1][0] if motion and n - 1 in to else None)
            out |= {(walk_id, n, d): s for d, s in zip(v.det_id, got, strict=True)}
    return out
