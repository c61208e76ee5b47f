"""Capacity-limited clustering of the points of one zone.

Points join clusters from the rim outwards: in each round the unallocated points are
weighed by how unsaturated their nearest cluster is, how much nearer it is than the
second one, and how far the step onto it is compared with the steps already taken
there; the heaviest ones that are not close together join. Afterwards clusters are added
or removed once, by total saturation. A strategy object says how full a cluster is and
which labelling is worth keeping; it is the extension point.
"""

from __future__ import annotations

import math

import numpy as np

from parcelwise.operators.paths import PairTimes
from parcelwise.operators.tours import tour

DAY, USUAL_STEP = 24 * 3600.0, 600.0
MOST_TABLE = 3000  # coordinates of which all distances are held
AROUND = sorted(((u, v) for u in range(-2, 3) for v in range(-2, 3) if (u, v) != (0, 0)), key=lambda c: c[0] ** 2 + c[1] ** 2)


def degrees(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]
    x *= x
    y *= y
    x += y
    return np.sqrt(x, out=x)


def km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle distances of points a from one point b."""
    a, b = np.radians(a), np.radians(b)
    chord = np.sin((a[:, 0] - b[0]) / 2) ** 2 + np.cos(a[:, 0]) * np.cos(b[0]) * np.sin((a[:, 1] - b[1]) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(1.0, chord)))


class SizeLimit:
    """A cluster's share of a target size; labellings are kept while sizes get more even.

    With `held` each point stands for so many, all at its coordinate.
    """

    split_over = 10.0

    def __init__(self, target: int, held: np.ndarray | None = None):
        self.target, self.held, self.best = target, held, math.inf

    def sizes(self, labels: np.ndarray, n_clusters: int) -> np.ndarray:
        inside = labels >= 0
        return np.bincount(labels[inside], None if self.held is None else self.held[inside], n_clusters)

    def saturation(self, labels: np.ndarray, which: list[int], n_clusters: int, step: int) -> list[float]:
        return (self.sizes(labels, n_clusters)[which] / self.target).tolist()

    def worth_keeping(self, labels: np.ndarray, progress: float) -> bool:
        sizes = self.sizes(labels, int(labels.max()) + 1)
        even = float(np.std(sizes[sizes > 0]))
        if even < self.best:
            self.best = even
            return True
        return False


class ShiftLimit:
    """A route's drive and service time as a share of the shift; routes may run over by 30 to 50 %."""

    split_over, held = 1.3, None

    def __init__(self, points: np.ndarray, nodes: list[int], depots: np.ndarray, depot_nodes: list[int], seconds: PairTimes, per_stop: float, shift: float):
        self.points, self.nodes, self.depots, self.depot_nodes = points, nodes, depots, depot_nodes
        self.seconds, self.per_stop, self.shift, self.best = seconds, per_stop, shift, math.inf
        self.key: tuple[int, int] = (-1, -1)
        self.known: dict[int, tuple[float, int]] = {}
        self.driven: dict[bytes, float] = {}

    def route(self, members: np.ndarray) -> float:
        """Seconds of a route; the same stops are driven once."""
        key = members.tobytes()
        if key not in self.driven:
            if len(self.driven) > 20_000:
                self.driven.clear()
            depot = int(np.argmin(np.linalg.norm(self.depots - self.points[members].mean(0), axis=1)))
            drive, _ = tour([self.nodes[i] for i in members], self.depot_nodes[depot], self.seconds)
            self.driven[key] = drive + self.per_stop * len(members)
        return self.driven[key]

    def saturation(self, labels: np.ndarray, which: list[int], n_clusters: int, step: int) -> list[float]:
        """Routes are only driven anew when the estimate by points exceeds the last true value by 0.2, or 0.1 near a full shift."""
        if self.key != (step, n_clusters):
            self.key, self.known = (step, n_clusters), {}
        out = []
        for w in which:
            members = np.flatnonzero(labels == w)
            if not len(members):
                out.append(0.0)
                continue
            value, n = self.known.get(w, (0.0, 0))
            guess = value / n * len(members) if n else math.inf
            if guess - value > (0.2 if guess < 0.9 else 0.1):
                self.known[w] = guess, _ = self.route(members) / self.shift, len(members)
            out.append(guess)
        return out

    def worth_keeping(self, labels: np.ndarray, progress: float) -> bool:
        times = [self.route(np.flatnonzero(labels == w)) for w in np.unique(labels)]
        over = 1.5 if progress > 0.8 else 1.4 if progress > 0.5 else 1.3
        spread = float(np.std(times))
        if max(times) < self.shift * over and spread < self.best * 0.95:
            self.best = spread
            return True
        return False


class Nearest:
    """Of each coordinate, the two clusters nearest by an allocated point, and the two nearest other allocated points.

    Every coordinate counts once, for its first allocated point: repeated stops would make
    all usual steps zero. Newly allocated points reach only the coordinates to which they
    are nearer than what those hold, so no table of clusters by points is kept.
    """

    def __init__(self, clusterer: Clusterer, k: int):
        self.of, self.k = clusterer, k
        n = len(clusterer.spots)
        self.held, self.label = np.full(n, -1), np.full(n, -1)
        self.clear()

    def clear(self) -> None:
        n = len(self.held)
        self.away, self.cluster, self.spot = np.full((2, n), np.inf), np.full((2, n), -1), np.full((2, n), -1)
        self.step, self.beside = np.full((2, n), np.inf), np.full((2, n), -1)
        self.reach = np.full(n, np.inf)

    def points(self) -> np.ndarray:
        """The points that stand for the allocated coordinates."""
        return self.held[self.held >= 0]

    def of_cluster(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each point, the distance and number of the cluster's nearest allocated point; inf and -1 if it has none."""
        own = np.flatnonzero((self.held >= 0) & (self.label == c))
        if not len(own):
            return np.full(len(self.of.place), np.inf), np.full(len(self.of.place), -1)
        apart = degrees(self.of.spots, self.of.spots[own])
        return apart.min(1)[self.of.place], self.held[own[apart.argmin(1)]][self.of.place]

    @property
    def far(self) -> np.ndarray:
        """By cluster and point, found anew."""
        return np.array([self.of_cluster(c)[0] for c in range(self.k)])

    @property
    def who(self) -> np.ndarray:
        return np.array([self.of_cluster(c)[1] for c in range(self.k)])

    def add(self, which: np.ndarray, labels: np.ndarray) -> None:
        which = np.sort(which)
        at, firsts = np.unique(self.of.place[which], return_index=True)
        first = which[firsts]
        before = self.held[at]
        news = (before < 0) | (first < before)
        at, first, before = at[news], first[news], before[news]
        other = (before >= 0) & (self.label[at] != labels[first])  # coordinates that change their cluster
        self.held[at], self.label[at] = first, labels[first]
        if other.any() or not (np.isfinite(self.away[1, 0]) and np.isfinite(self.step[1]).all()):
            self.anew()
        elif len(fresh := at[before < 0]):
            self.take(fresh)

    def anew(self) -> None:
        """Everything from all allocated coordinates, some rows of distances at a time."""
        self.clear()
        own = np.flatnonzero(self.held >= 0)
        own = own[np.argsort(self.label[own], kind="stable")]  # so that the first of equals is of the lowest label
        theirs, n = self.label[own], len(self.held)
        at = np.full(n, -1)
        at[own] = np.arange(len(own))
        several = theirs[0] != theirs[-1]
        for low in range(0, n, size := max(1, 2_000_000 // len(own))):
            high = min(low + size, n)
            rows = np.arange(high - low)
            apart = degrees(self.of.spots[low:high], self.of.spots[own]) if self.of.table is None else self.of.table[low:high][:, own]
            near = apart.argmin(1)
            self.away[0, low:high], self.cluster[0, low:high], self.spot[0, low:high] = apart[rows, near], theirs[near], own[near]
            if several:
                others = np.where(theirs[None, :] == theirs[near][:, None], np.inf, apart)
                near = others.argmin(1)
                self.away[1, low:high], self.cluster[1, low:high], self.spot[1, low:high] = others[rows, near], theirs[near], own[near]
            mine = np.flatnonzero(at[low:high] >= 0)
            apart[mine, at[low:high][mine]] = np.inf
            for j in range(min(2, len(own))):
                near = apart.argmin(1)
                found = apart[rows, near]
                self.step[j, low:high], self.beside[j, low:high] = found, np.where(np.isfinite(found), own[near], -1)
                apart[rows, near] = np.inf
        self.bound(np.arange(n))

    def bound(self, which: np.ndarray) -> None:
        """How near a new point must be to change what a coordinate holds; without points left there its clusters don't matter."""
        self.reach[which] = np.maximum(self.away[1, which], self.step[1, which])
        if self.of.single:
            done = which[self.held[which] >= 0]
            self.reach[done] = self.step[1, done]

    def take(self, fresh: np.ndarray) -> None:
        """Adds coordinates that were not allocated; two clusters and three coordinates are, so all distances held are finite."""
        apart = degrees(self.of.spots[fresh], self.of.spots) if self.of.table is None else self.of.table[fresh]
        i, q = np.divmod(np.flatnonzero(apart < self.reach), len(self.held))
        d, p = apart[i, q], fresh[i]
        met = np.zeros(len(self.held), bool)
        met[q] = True
        met = np.flatnonzero(met)
        # clusters: of each coordinate met, the nearest and the nearest of another label
        near = d <= self.away[1, q]
        at, far = np.concatenate([q[near], met, met]), np.concatenate([d[near], self.away[0, met], self.away[1, met]])
        label, spot = np.concatenate([self.label[p[near]], self.cluster[0, met], self.cluster[1, met]]), np.concatenate([p[near], self.spot[0, met], self.spot[1, met]])
        order = np.lexsort((label, far, at))
        at, far, label, spot = at[order], far[order], label[order], spot[order]
        first = firsts(at)
        self.away[0, met], self.cluster[0, met], self.spot[0, met] = far[first], label[first], spot[first]
        others = np.flatnonzero(label != self.cluster[0, at])
        second = others[firsts(at[others])]
        self.away[1, met], self.cluster[1, met], self.spot[1, met] = far[second], label[second], spot[second]
        # steps: the two nearest other coordinates
        near = (d < self.step[1, q]) & (p != q)
        at, far = np.concatenate([met, met, q[near]]), np.concatenate([self.step[0, met], self.step[1, met], d[near]])
        spot = np.concatenate([self.beside[0, met], self.beside[1, met], p[near]])
        order = np.lexsort((far, at))
        first = firsts(at[order])
        for j in range(2):
            self.step[j, met], self.beside[j, met] = far[order[first + j]], spot[order[first + j]]
        self.bound(np.concatenate([met, fresh]))


def firsts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def thinned(heaviest: np.ndarray, points: np.ndarray, radius: float) -> list[int]:
    """Of points in order, those at least `radius` from all kept before; cells less than that across hold one each."""
    if not radius:
        return heaviest.tolist()
    side, r2, out = radius * 0.7, radius * radius, []
    spots = points[heaviest]
    cells = np.floor((spots - spots.min(0)) / side).astype(np.int64)
    width = int(cells[:, 1].max()) + 5
    around = [u * width + v for u, v in AROUND]
    taken: dict[int, tuple[float, float]] = {}
    for i, (x, y), (a, b) in zip(heaviest.tolist(), spots.tolist(), cells.tolist(), strict=True):
        if (cell := a * width + b) in taken:
            continue
        for step in around:
            if (other := taken.get(cell + step)) is not None and (other[0] - x) * (other[0] - x) + (other[1] - y) * (other[1] - y) < r2:
                break
        else:
            taken[cell] = x, y
            out.append(i)
    return out


class Clusterer:
    """`nodes` and `seconds` give drive times between points; without them they count as unknown."""

    def __init__(self, points: np.ndarray, strategy, nodes: list[int] | None = None, seconds: PairTimes | None = None, seed: int = 0):
        self.points, self.strategy = np.asarray(points, float), strategy
        self.seconds = seconds
        self.node = None if seconds is None else np.searchsorted(seconds.ids, np.asarray(nodes))
        self.random = np.random.default_rng(seed)
        self.step = 0
        self.spots, place = np.unique(self.points, axis=0, return_inverse=True) if len(self.points) else (np.zeros((0, 2)), np.zeros(0, int))
        self.place, self.single = place.ravel(), len(self.spots) == len(self.points)
        self.table = degrees(self.spots, self.spots) if len(self.spots) <= MOST_TABLE else None

    def drives(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Seconds from each point of a to its counterpart in b, nan where unknown."""
        out = self.seconds.seconds[self.node[a], self.node[b]]
        return np.where(np.isfinite(out), out, np.nan)

    def usual_drives(self, around: np.ndarray, near: Nearest) -> np.ndarray:
        """For allocated coordinates, the mean drive time to their two nearest allocated neighbours."""
        known, total = np.zeros(len(around)), np.zeros(len(around))
        for beside in near.beside[:, around]:
            t = np.where(beside < 0, np.nan, self.drives(near.held[around], near.held[beside]))
            known += ~np.isnan(t)
            total += np.nan_to_num(t)
        return np.where(known > 0, total / np.maximum(known, 1), USUAL_STEP)

    def weights(self, left: np.ndarray, labels: np.ndarray, full: np.ndarray, near: Nearest) -> np.ndarray:
        """Of the points left, from the clusters' nearest allocated points."""
        at = self.place[left]
        d1, d2 = near.away[:, at]
        if len(left) and not np.isfinite(d2[0]):
            raise ValueError("weighing needs at least two clusters")
        rim = near.spot[0, at]
        step1, step2 = near.step[:, rim]
        usual_d = np.where(np.isfinite(step2), (step1 + step2) / 2, np.where(np.isfinite(step1), step1, 0.0))
        ratio = lambda x, y: x / np.maximum(y, 1e-12)
        fade = lambda x, power: np.where(x < 2, 1.0, np.maximum(x - 1, 1.0) ** power)
        if self.seconds is None:
            t1 = t2 = np.full(1, DAY)
            usual_t = np.full(1, USUAL_STEP)
        else:
            t1, t2 = (np.where(np.isnan(t) | (t == 0), DAY, t) for t in (self.drives(left, near.held[x]) for x in near.spot[:, at]))
            usual_t = self.usual_drives(rim, near)
        lead = np.minimum(ratio(t2, t1), 10.0) * np.minimum(ratio(d2, d1), 10.0)
        span = fade(ratio(t1, usual_t), -0.4) * fade(ratio(d1, usual_d), -1.0)
        return (np.maximum(full, 1e-12) ** -7)[near.cluster[0, at]] * lead * span

    def seeded(self, centroids: np.ndarray, seeds: int) -> np.ndarray:
        """Labels of the `seeds` points nearest to each centroid, -1 elsewhere; of two centroids the later one has a point."""
        labels = np.full(len(self.points), -1)
        apart = degrees(centroids, self.points)
        last = np.partition(apart, seeds - 1, 1)[:, seeds - 1]
        c, i = np.divmod(np.flatnonzero(apart <= last[:, None]), len(self.points))
        order = np.lexsort((i, apart[c, i], c))
        c, i = c[order], i[order]
        rank = np.arange(len(c)) - np.searchsorted(c, c)
        np.maximum.at(labels, i[rank < seeds], c[rank < seeds])
        return labels

    def assign(self, centroids: np.ndarray, may_resize: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(labels, the centroids they were grown from)."""
        points, n, k = self.points, len(self.points), len(centroids)
        labels = self.seeded(centroids, max(1, min(int(n / k * 0.2), 10)))
        full = np.full(k, 0.01)
        if self.strategy.held is not None:  # few coordinates: the seeds are much of a cluster, or all of it
            full = np.maximum(full, self.strategy.saturation(labels, list(range(k)), k, self.step))
        between = degrees(centroids[:1], centroids[1:])
        radius = float(between.min()) / 2 if k > 1 else 0.0
        near = Nearest(self, k)
        near.add(np.flatnonzero(labels >= 0), labels)
        while len(left := np.flatnonzero(labels < 0)):
            if np.isfinite(near.away[1, 0]):
                weights = self.weights(left, labels, full, near)
            else:
                weights = np.ones(len(left))
            many = k * next(m for over, m in ((0.9, 1), (0.7, 2), (0.4, 3), (-1.0, 5)) if full.max() > over)
            placed = np.array(thinned(left[np.argsort(-weights, kind="stable")[:many]], points, radius))
            labels[placed] = near.cluster[0, self.place[placed]]
            touched = np.unique(labels[placed]).tolist()
            near.add(placed, labels)
            full[touched] = self.strategy.saturation(labels, touched, k, self.step)
        return self.resized(labels, centroids, full) if may_resize else (labels, centroids)

    def another(self, labels: np.ndarray, centroids: np.ndarray, c: int) -> np.ndarray | None:
        """A random member of a cluster that is not its centroid, within three tries."""
        members = np.flatnonzero(labels == c)
        for _ in range(3 if len(members) else 0):
            p = self.points[self.random.choice(members)]
            if np.linalg.norm(p - centroids[c]) > 1e-10:
                return p
        return None

    def resized(self, labels: np.ndarray, centroids: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, slack = len(centroids), 1 if self.step <= 10 else 1.25 if self.step <= 20 else 1.5
        need = 0.95 * float(full.sum())
        grown: list[np.ndarray | None] = []
        if need > k + slack:
            grown = [self.another(labels, centroids, c) for c in np.argsort(-full, kind="stable")[: round(need - k)]]
        elif need < k - slack:
            if (less := min(round(k - need), k - 2)) > 0:
                return self.assign(np.delete(centroids, np.argsort(full, kind="stable")[:less], axis=0), False)
        elif full.max() > self.strategy.split_over:
            grown = [self.another(labels, centroids, int(full.argmax()))]
        if grown := [p for p in grown if p is not None]:
            return self.assign(np.vstack([centroids, grown]), False)
        return labels, centroids

    def moved(self, labels: np.ndarray) -> np.ndarray:
        """New centroids: a random one of the fifth of each cluster that is nearest to its weighted centre."""
        out = []
        for c in np.unique(labels):
            own = self.points[labels == c]
            held = None if self.strategy.held is None else self.strategy.held[labels == c]
            w = np.exp(-np.linalg.norm(own - (own.mean(0) if held is None else np.average(own, 0, held)), axis=1))
            w = w if held is None else w * held
            order = np.argsort(km(own, (own * w[:, None]).sum(0) / w.sum()), kind="stable")
            out.append(own[self.random.choice(order[: max(round(0.2 * len(own)), 1)])])
        return np.array(out)

    def run(self, centroids: np.ndarray, patience: int = 10, most_rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """The last labelling worth keeping, and its centroids; `patience` rounds without a better one end it."""
        kept, waited = None, 0
        for self.step in range(most_rounds):
            labels, used = self.assign(centroids)
            centroids = self.moved(labels)
            if self.strategy.worth_keeping(labels, self.step / most_rounds):
                kept, waited = (labels.copy(), used), 0
            elif kept is not None:
                waited += 1
                if waited >= patience:
                    break
        if kept is None:
            raise ValueError("no labelling keeps to the limits")
        return kept


def chosen(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    return points[np.random.default_rng(seed).choice(len(points), min(k, len(points)), replace=False)]


def by_size(points: np.ndarray, target: int, patience: int = 1, seed: int = 0) -> np.ndarray:
    """Dense labels of clusters of about `target` points (a target, not a cap); all points at a coordinate get one label."""
    k = math.ceil(len(points) / target)
    if k < 2 or len(points) < 4:
        return np.zeros(len(points), int)
    spots, place, held = np.unique(np.asarray(points, float), axis=0, return_inverse=True, return_counts=True)
    place = place.ravel()
    if len(spots) == len(points):
        labels, _ = Clusterer(points, SizeLimit(target), seed=seed).run(chosen(points, k, seed), patience)
    elif k < len(spots):
        labels = Clusterer(spots, SizeLimit(target, held), seed=seed).run(chosen(spots, k, seed), patience)[0][place]
    else:
        labels = place
    return np.unique(labels, return_inverse=True)[1]


def by_shift(points: np.ndarray, nodes: list[int], depots: np.ndarray, depot_nodes: list[int], seconds: PairTimes, per_stop: float = 300.0, shift: float = 36000.0, patience: int = 3, seed: int = 0, most_rounds: int = 100) -> np.ndarray:
    """Dense labels of routes whose drive and service time fits the shift, softly."""
    if len(points) < 4:
        return np.zeros(len(points), int)
    k = min(max(math.ceil(len(points) / (shift / 3600.0 * 5)), 2), len(points))
    limit = ShiftLimit(points, nodes, depots, depot_nodes, seconds, per_stop, shift)
    labels, _ = Clusterer(points, limit, nodes, seconds, seed).run(chosen(points, k, seed), patience, most_rounds)
    return np.unique(labels, return_inverse=True)[1]
