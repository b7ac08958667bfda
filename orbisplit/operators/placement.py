"""Where anchors go, and how many points they may take: radii, proposals, quotas, and the scan that accepts anchors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbisplit.config import Config
from orbisplit.functions.vectors import uniform
from orbisplit.operators import density as dens
from orbisplit.operators import sampling, spheres
from orbisplit.operators.dedup import far_from, spacing_filter, uncovered
from orbisplit.operators.blocks import matrix
from orbisplit.operators.pairs import distances, knn_cross, pair_histogram, pair_values
from orbisplit.operators.quantiles import exact_quantile
from orbisplit.operators.scans import Scan
from orbisplit.sources.tables import materialise

#: Distances of a bin up to which they are written to be put in order (eight bytes each), a fuller bin is divided again; and rows that a first guess is made on.
KEPT, GUESSED = 4_000_000, 1024
#: Pairs of candidates and rows in reach that one task settles one by one (about 40 bytes each).
SCANNED = 1_000_000
#: Unassigned rows below which a class has no candidates of its own; and the bit above the numbers of a class's candidates.
LEAST_OF_CLASS, RANK = 5, 40


def num_anchors(n: Column, ratio: float, least: int = 3) -> Column:
    """How many anchors n points need: enough for the eval share, between a floor by the root of n and a third of n."""
    whole = lambda c: F.floor(c).cast("long")
    per = F.greatest(F.lit(5), F.least(F.lit(15), whole(n / 10)))
    wanted = whole(F.greatest(F.lit(1), whole(n * ratio)) / per)
    low = F.greatest(F.lit(1), whole(F.sqrt(n) / 5))
    high = F.greatest(F.lit(least), whole(n / 3))
    return F.least(F.greatest(wanted, low), high).cast("long")


def anchors_for(n: int, ratio: float, least: int = 3) -> int:
    per = max(5, min(15, n // 10))
    low, high = max(1, int(math.sqrt(n) / 5)), max(least, n // 3)
    return min(max(max(1, int(n * ratio)) // per, low), high)


def base_radius(p: DataFrame, config: Config) -> float:
    """A quantile of all pair distances times a scale, within the bounds; fixed where that is set."""
    s = config.spheres
    if s.radius == "fixed":
        return s.fixed_radius
    if p.count() < 2:
        return s.min_radius
    bounds = (s.min_radius / s.radius_scale, s.max_radius / s.radius_scale) if s.radius_scale > 0 else ()
    found = pair_quantile(p, config.metric, s.percentile / 100, *bounds)
    return float(min(max(found * s.radius_scale, s.min_radius), s.max_radius))


def pair_quantile(p: DataFrame, metric: str, share: float, least: float = 0.0, most: float = math.inf, bins: int = 4096) -> float:
    """The quantile of all pair distances, with linear interpolation; 0 where it is up to ``least``, infinite where it is ``most`` or more, which one
    count of all pairs settles. Distances are made anew in each pass, and only counts leave the tasks until KEPT values or fewer are left.

    Some rows' own quantile says where to look first. Each pass counts all pairs, those outside too, so a wrong guess costs a pass and nothing else."""
    histogram = lambda a, b, n: sorted(pair_histogram(p, metric, a, b, n).collect(), key=lambda r: r.b)
    guess = _guess(p, metric, share)
    for edge, beyond in ((most, math.inf), (least, 0.0)):
        if guess and (guess[0] >= edge if beyond else guess[1] <= edge):
            rows = histogram(edge, edge, 1)
            if not rows:
                return math.nan
            k, _, after, ends = _ranks(rows, share)
            if k >= sum(r.c for r in rows if r.b < 0) if beyond else after < sum(r.c for r in rows if r.b <= 0):
                return beyond
    low, high = guess or _widest(p, metric)
    while True:
        rows = histogram(low, high, bins)
        if not rows:
            return math.nan
        k, part, after, ends = _ranks(rows, share)
        i, j = (int(np.searchsorted(ends, m, side="right")) for m in (k, after))
        if rows[i].b < 0 or rows[j].b == bins:
            low, high = _widest(p, metric)
        elif i != j:  # the last value of one bin and the first of the next
            return float(rows[i].high + part * (rows[j].low - rows[i].high))
        elif rows[i].low == rows[i].high:
            return float(rows[i].low)
        else:
            low, high, held, below = rows[i].low, rows[i].high, rows[i].c, int(ends[i]) - rows[i].c
            if held <= KEPT:
                values = Scan(materialise(pair_values(p, metric, low, high), "pair-values"), [], ["d"]).number("place").rows()
                x = sorted(r.d for r in values.where(F.col("place").isin(k - below + 1, after - below + 1)).collect())  # two values
                return float(x[0] + part * (x[-1] - x[0]))


def _ranks(rows: list, share: float) -> tuple[int, float, int, np.ndarray]:
    """The places of the quantile's two neighbours, what of the way to the second it goes, and the counts up to each bin."""
    ends = np.cumsum([r.c for r in rows])
    at = share * (int(ends[-1]) - 1)
    k = int(math.floor(at))
    return k, at - k, min(k + 1, int(ends[-1]) - 1), ends


def _widest(p: DataFrame, metric: str) -> tuple[float, float]:
    """The least and the largest distance, or what none passes."""
    if metric == "cosine":
        return 0.0, 2.0 + 1e-6  # more than rounding adds
    low, high = pair_histogram(p, metric, 0.0, math.inf, 1).agg(F.min("low"), F.max("high")).first()
    return (0.0, 0.0) if low is None else (low, high)


def _guess(p: DataFrame, metric: str, share: float) -> tuple[float, float] | None:
    """Distances between which the quantile lies by GUESSED rows' pairs, five deviations to either side; none where that leaves the range."""
    v = np.array([r.v for r in p.select("v").orderBy(F.xxhash64("id", "v")).limit(GUESSED).collect()], np.float64)
    v = v[np.isfinite(v).all(1)] if v.ndim == 2 else v[:0]
    if len(v) < 2:
        return None
    d = matrix(v, v, metric)
    pairs = d[np.triu_indices(len(v), 1)]
    margin = 10.0 * float((d < np.quantile(pairs, share)).mean(1).std()) / math.sqrt(len(v)) + 0.002
    if not margin < share < 1.0 - margin:
        return None
    low, high = np.quantile(pairs, (share - margin, share + margin))
    return float(low), float(high)


def snap(candidates: DataFrame, p: DataFrame, config: Config) -> DataFrame:
    """(id, v) moved to a point nearby: the nearest, or one of snap_k by weights 1 / dimensionality (equal where any is
    not a positive number), drawn by hashed exponential keys. Dimensionality is looked at where candidates are: it is no number for all
    points or for none."""
    if config.placement.snap != "lid":
        pick = knn_cross(candidates, p, 1, config.metric)
    else:
        near = knn_cross(candidates, p, config.placement.snap_k, config.metric)
        near = materialise(near, "snap-near")
        lids = dens.lid_at(p.join(near.select(F.col("r").alias("id")).distinct(), "id", "left_semi"), p, metric=config.metric).select(F.col("id").alias("r"), "lid")
        lids = materialise(lids, "snap-lids")
        good = bool(lids.agg(F.min(((F.col("lid") > 0) & ~F.isnan("lid")).cast("int"))).first()[0])
        weight = F.lit(1.0) / F.col("lid") if good else F.lit(1.0)
        key = -F.log(F.greatest(uniform(config.seed, F.lit("snap"), F.col("l"), F.col("r")), F.lit(1e-12))) / weight
        by = Window.partitionBy("l").orderBy("key", "r")
        pick = near.join(lids, "r").withColumn("key", key).withColumn("rank", F.row_number().over(by)).where("rank = 1")
    return pick.select(F.col("l").alias("id"), "r").join(p.withColumnRenamed("id", "r"), "r").select("id", "v")


def propose(p: DataFrame, existing: DataFrame, config: Config, num: int | None = None, filtered: bool = True) -> DataFrame:
    """(id, v): quasi-random or uniform points in the box of p, spaced from each other and from existing ones, snapped."""
    pl = config.placement
    num = num or max(3, pl.overpropose * anchors_for(p.count(), config.splits.eval, pl.min_points_per_anchor))
    low, high = sampling.box_arrays(p)
    if len(low) == 0:
        return p.limit(0)
    if not filtered and bool((low >= high).any()):
        return p  # no box to sample: the points themselves
    kind = "random" if pl.method == "random" else "halton" if pl.engine == "halton" else "sobol"
    c = sampling.points_in_box(p.sparkSession, kind, num, low, high, config.seed)
    c = far_from(spacing_filter(c, pl.min_distance, config.metric), existing, pl.min_distance, config.metric)
    return snap(materialise(c, "candidates"), p, config)


def place(p: DataFrame, config: Config, num: int | None = None) -> DataFrame:
    """(id, v) of stand-alone placement: quasi-random (snapped), random (twice as many, spaced, cut), or k-means centres."""
    n = num or anchors_for(p.count(), config.splits.eval, config.placement.min_points_per_anchor)
    low, high = sampling.box_arrays(p)
    spark = p.sparkSession
    if config.placement.method == "kmeans":
        c = kmeans_centers(p, n, config.seed)
        return spacing_filter(c, config.placement.min_distance, config.metric)
    if config.placement.method == "random":
        c = sampling.points_in_box(spark, "random", 2 * n, low, high, config.seed)
        return spacing_filter(c, config.placement.min_distance, config.metric).orderBy("id").limit(n)
    c = sampling.points_in_box(spark, "sobol", n, low, high, config.seed)
    return snap(spacing_filter(c, config.placement.min_distance, config.metric), p, config)


def place_more(p: DataFrame, existing: DataFrame, radius: float, config: Config) -> DataFrame:
    """Further anchors over points that no existing centre covers, none close to one."""
    rest = materialise(uncovered(p, existing, radius, config.metric), "uncovered")
    if rest.isEmpty():
        return rest.select("id", "v")
    return far_from(place(rest, config), existing, config.placement.min_distance, config.metric)


def kmeans_centers(p: DataFrame, k: int, seed: int = 42, starts: int = 10, rounds: int = 100) -> DataFrame:
    """(id, v): the centres of the best of some starts, in order of their components. A start begins at the k rows that its hash puts first; all
    starts move in the same passes over the data, which send sums alone: starts * k * width numbers reach the driver. A centre without rows stays."""
    spark, order = p.sparkSession, {}
    for s in range(starts):
        key = F.xxhash64(F.lit(seed), F.lit(s), "id", "v")
        order[s] = np.array([r.v for r in p.orderBy(key, "id").limit(k).collect()], np.float64)  # k rows
    if not len(order[0]):
        return p.select("id", "v").limit(0)
    centers = np.array([order[s] for s in range(starts)])
    inertia = np.zeros(starts)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(centers)

        def sums(batches: Iterator[pa.RecordBatch], now: Broadcast = now) -> Iterator[pa.RecordBatch]:
            c = now.value
            total = np.zeros((*c.shape[:2], c.shape[2] + 2))
            for b in batches:
                if b.num_rows:
                    v = np.asarray(b.column("v").flatten()).reshape(b.num_rows, -1)
                    for s in range(len(c)):
                        d = matrix(v, c[s], "euclidean")
                        at = d.argmin(1)
                        np.add.at(total[s], at, np.hstack([v, np.ones((len(v), 1)), d.min(1)[:, None] ** 2]))
            s, i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s, i, j, total[s, i, j])], ["s", "c", "i", "x"])

        total = np.zeros((*centers.shape[:2], centers.shape[2] + 2))
        for r in p.select("v").mapInArrow(sums, "s long, c long, i long, x double").groupBy("s", "c", "i").agg(F.sum("x").alias("x")).collect():
            total[r.s, r.c, r.i] = r.x
        n = total[:, :, -2:-1]
        inertia = total[:, :, -1].sum(1)
        moved = np.where(n > 0, total[:, :, :-2] / np.maximum(n, 1), centers)
        done = np.abs(moved - centers).max() <= 1e-9
        if done:
            break
        centers = moved
    best = centers[int(np.argmin(inertia))]
    return sampling.as_points(spark, np.array(sorted(tuple(map(float, c)) for c in best)))


def valid_radius(radius: Column, nearest: Column, low: float, steps: int = 4) -> Column:
    """The first of radius, radius / 2, … (steps halvings, none below low) that stays short of the nearest stored training row;
    null if none does. Without stored rows (null) the radius itself."""
    out = F.lit(None).cast("double")
    for k in reversed(range(steps + 1)):
        r = F.greatest(radius / float(2**k), F.lit(low)) if k else radius
        out = F.when(nearest.isNull() | (nearest > r), r).otherwise(out)
    return out


def validate(candidates: DataFrame, train: DataFrame, low: float, metric: str = "cosine") -> DataFrame:
    """candidates (id, v, radius) with a radius that no stored training row lies in; others are left out."""
    if train.isEmpty():
        return candidates.where("radius is not null")
    reach = candidates.agg(F.max("radius")).first()[0]
    near = distances(candidates.select("id", "v"), train, metric, within=reach if reach is not None else -1.0)
    near = near.groupBy(F.col("l").alias("id")).agg(F.min("d").alias("near"))
    return candidates.join(near, "id", "left").withColumn("radius", valid_radius(F.col("radius"), F.col("near"), low)).where("radius is not null").drop("near")


#: How often the radius is halved between the least one and its own.
HALVINGS = 5


def capped_radius(d: np.ndarray, radius: float, allowed: int, low: float, steps: int = HALVINGS) -> float:
    """The radius, or after bisection one that captures (d < radius) no more than allowed."""
    if (d < radius).sum() <= allowed:
        return radius
    a, b = low, radius
    for _ in range(steps):
        middle = (a + b) / 2
        a, b = (a, middle) if (d < middle).sum() > allowed else (middle, b)
    return a


def eval_deficit(stored_train: int, stored_eval: int, n: int, new_eval: int, config: Config, unassigned: int = 1) -> int:
    """Eval rows still wanted; at least the minimum of the batch where it would get none."""
    target = int((stored_train + stored_eval + n) * config.splits.eval)
    deficit = target - (stored_eval + new_eval)
    least = int(n * config.splits.min_eval_per_batch)
    return least if deficit <= 0 and new_eval == 0 and least >= 1 and unassigned else deficit


@dataclass
class Ledger:
    """What acceptance has given out, in all and by class: counts alone. Which rows are taken stands in tables."""

    target: int
    n_eval: int
    overshoot: int
    low: float
    by_class: dict[str, int] = field(default_factory=dict)

    @property
    def full(self) -> bool:
        return self.n_eval >= self.target

    def offer(self, d: np.ndarray, labels: np.ndarray, radius: float) -> float | None:
        """The radius, capped to what is still wanted, if more than one of the free rows in reach (distances d) counts for eval."""
        radius = capped_radius(d, radius, self.target - self.n_eval + self.overshoot, self.low)
        inside = d < radius
        if inside.sum() <= 1:
            return None
        self.count(int(inside.sum()), labels[inside])
        return radius

    def count(self, n: int, labels: Iterable[str | None]) -> None:
        self.n_eval += n
        for label in labels:
            if label is not None:
                self.by_class[label] = self.by_class.get(label, 0) + 1


@dataclass(frozen=True)
class Goal:
    """A class: its eval target, and how much of it its own candidates fill."""

    label: str
    target: int

    @property
    def fill(self) -> int:
        return int(0.8 * self.target)

    def open(self, ledger: Ledger) -> bool:
        """Past the overall target only classes below half of their own go on."""
        have = ledger.by_class.get(self.label, 0)
        return have < self.fill and (not ledger.full or have < 0.5 * self.target)


#: By the rank of a class, which is in the upper bits of the ids of its candidates.
Goals = Mapping[int, Goal]


def _offered(ledger: Ledger, goals: Goals | None, candidate: int) -> bool:
    return goals[candidate >> RANK].open(ledger) if goals else not ledger.full


def _in_order(pairs: pa.Table, ledger: Ledger, goals: Goals | None) -> pa.Table:
    """Candidates of some pairs (c, radius, d, r, label), one after another: (c, radius, label, n) of those accepted, in all and by label."""
    pairs = pairs.sort_by([("c", "ascending"), ("d", "ascending"), ("r", "ascending")])
    c, radii, d, r = (pairs.column(x).to_numpy() for x in ("c", "radius", "d", "r"))
    labels = np.array(pairs.column("label").to_pylist(), object)
    taken: set[int] = set()
    out: list[tuple[int, float, str | None, int]] = []
    starts = np.flatnonzero(np.diff(c, prepend=c[0] - 1)) if len(c) else np.zeros(0, np.int64)
    for start, end in zip(starts, [*starts[1:], len(c)], strict=True):
        candidate = int(c[start])
        if not goals and ledger.full:
            break
        if not _offered(ledger, goals, candidate):
            continue
        free = start + np.flatnonzero([x not in taken for x in r[start:end].tolist()])
        before = dict(ledger.by_class), ledger.n_eval
        radius = ledger.offer(d[free], labels[free], float(radii[start]))
        if radius is None:
            continue
        taken.update(r[free[d[free] <= radius]].tolist())
        out.append((candidate, radius, None, ledger.n_eval - before[1]))
        out += [(candidate, radius, k, n - before[0].get(k, 0)) for k, n in ledger.by_class.items() if n != before[0].get(k, 0)]
    columns = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.table({k: pa.array(x, t) for (k, t), x in zip({"c": pa.int64(), "radius": pa.float64(), "label": pa.string(), "n": pa.int64()}.items(), columns, strict=True)})


def reach_pairs(c: DataFrame, p: DataFrame, config: Config, labels: bool = True) -> DataFrame | None:
    """(c, radius, d, r, label): candidates (id, v, radius) with the rows (id, v, label) within their radius; none without candidates."""
    reach = c.agg(F.max("radius")).first()[0]
    if reach is None:
        return None
    sparse = distances(c.select("id", "v"), p.select("id", "v"), config.metric, within=reach).withColumnRenamed("l", "c")
    sparse = sparse.join(c.select(F.col("id").alias("c"), "radius"), "c").where("d <= radius")
    named = p.select(F.col("id").alias("r"), F.lower("label").alias("label")) if labels else None
    return sparse.join(named, "r") if labels else sparse.withColumn("label", F.lit(None).cast("string"))


def settle(c: DataFrame, p: DataFrame, ledger: Ledger, config: Config, goals: Goals | None = None, scanned: int | None = None) -> DataFrame:
    """Candidates (id, v, radius) that are accepted, in order of their ids, over rows p (id, v, label), with the radius they were given.

    By its definition acceptance is sequential: a candidate sees what earlier ones left. But a candidate with one free row in its radius or none
    is refused whatever comes before, and one whose rows no earlier open candidate reaches has nothing to wait for, as long as the targets
    would not be met even if all earlier ones took all they reach. So acceptance goes in rounds over the pairs of candidates and free rows: each
    round settles all such candidates at once, and takes their rows and themselves out of the pairs. Where the targets come into play, the
    first candidates, up to ``scanned`` pairs, are settled one by one in one task, which returns radii and counts. Pairs, rows that are taken
    and candidates stay in tables; the driver reads counts only.
    """
    scanned = scanned or SCANNED
    none = c.select(F.col("id").alias("c"), "radius", F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("n")).limit(0)
    found = reach_pairs(c, p, config, labels=goals is not None)
    if found is None:
        return c.limit(0)
    left = materialise(found, "reach")
    accepted = none
    while goals or not ledger.full:
        sizes = materialise(left.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") < F.col("radius")).alias("a")), "reach-sizes")
        total = sizes.agg(F.sum("n")).first()[0]
        if not total:
            break
        if total <= scanned:
            accepted = accepted.unionByName(_scanned(left, ledger, goals))
            break
        took, done = _round(left, sizes, ledger, goals)
        if done.isEmpty():
            upto = Scan(sizes, [], ["c"]).running({"upto": F.col("n")}).rows()
            first = upto.where(F.col("upto") <= scanned).agg(F.max("c")).first()[0]
            if first is None:  # one candidate that reaches more
                took = _alone(left, sizes, ledger, goals)
                done = sizes.agg(F.min("c").alias("c"))
            else:
                took = _scanned(left.where(F.col("c") <= first), ledger, goals)
                done = sizes.where(F.col("c") <= first).select("c")
        accepted = accepted.unionByName(took)
        given = took.where("label is null").select("c", F.col("radius").alias("given"))
        gone = left.join(given, "c").where("d <= given").select("r").distinct()
        left = materialise(left.join(done, "c", "left_anti").join(gone, "r", "left_anti").select("c", "radius", "d", "r", "label"), "reach")
    given = accepted.where("label is null").select(F.col("c").alias("id"), "radius")
    return c.drop("radius").join(given, "id").select("id", "v", "radius")


#: Candidates that are given radii and compared with the rows at first, and how many times more each time after.
FIRST_OFFERED, MORE_OFFERED, OFFERED = 64, 4, 100_000


def settle_in_turn(c: DataFrame, radii: Callable[[DataFrame], DataFrame], p: DataFrame, ledger: Ledger, config: Config, goals: Goals | None = None) -> DataFrame:
    """As ``settle`` over radii(c) of candidates (id, v), a part of them at a time: those behind the one that meets the targets are refused
    whatever they reach, so they are given no radius and meet no row. Candidates of a class that is full stay out of the next part."""
    found, rows, left, wanted = None, p, c, FIRST_OFFERED
    while goals or not ledger.full:
        if goals:
            waiting = [i for i, g in goals.items() if g.open(ledger)]
            left = left.where(F.shiftright("id", RANK).isin(waiting))
        ids = left.select("id").orderBy("id").limit(wanted)
        last, n = ids.agg(F.max("id"), F.count(F.lit(1))).first()
        if not n:
            break
        whole = n < wanted or wanted > OFFERED
        part = radii(materialise(left if whole else left.where(F.col("id") <= last), "offered"))
        took = materialise(settle(part, rows, ledger, config, goals), "accepted")
        found = took if found is None else found.unionByName(took)
        if whole:
            break
        left, wanted = left.where(F.col("id") > last), wanted * MORE_OFFERED
        if not took.isEmpty():
            pairs = reach_pairs(took, rows.select("id", "v"), config, labels=False)
            rows = materialise(rows.join(pairs.select(F.col("r").alias("id")).distinct(), "id", "left_anti"), "free")
    return c.select("id", "v", F.lit(0.0).alias("radius")).limit(0) if found is None else found


ACCEPTED = "c long, radius double, label string, n long"


def _counted(took: DataFrame, ledger: Ledger) -> DataFrame:
    """Enter what was accepted (c, radius, label, n)."""
    for r in took.groupBy("label").agg(F.sum("n").alias("n")).collect():  # a row a class
        if r.label is None:
            ledger.n_eval += r.n
        else:
            ledger.by_class[r.label] = ledger.by_class.get(r.label, 0) + r.n
    return took


def _scanned(left: DataFrame, ledger: Ledger, goals: Goals | None) -> DataFrame:
    """Candidates one by one, in one task."""
    start = replace(ledger, by_class=dict(ledger.by_class))
    kernel = lambda t: _in_order(t, replace(start, by_class=dict(start.by_class)), goals)
    return _counted(materialise(left.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(kernel, ACCEPTED), "accepted"), ledger)


def _round(left: DataFrame, sizes: DataFrame, ledger: Ledger, goals: Goals | None) -> tuple[DataFrame, DataFrame]:
    """What is accepted (c, radius, label, n) whatever earlier candidates do, and all that is settled (c)."""
    first = left.groupBy("r").agg(F.min("c").alias("first"))
    waits = left.join(first, "r").where("c > first").select("c").distinct()
    upto = Scan(sizes, [], ["c"]).running({"upto": F.col("a")}).rows()
    sure = upto.where((F.col("a") > 1) & (F.col("upto") + ledger.n_eval <= ledger.target)).join(waits, "c", "left_anti")
    inside = left.where("d < radius")
    closed = sizes.select("c").where("false")
    if goals:
        # Nothing is settled past the place where all captures so far could fill a class that still has candidates.
        room = {i: (g.label, g.fill - ledger.by_class.get(g.label, 0)) for i, g in goals.items()}
        rank = F.shiftright("c", RANK)
        closed = sizes.where(rank.isin([i for i, (_, n) in room.items() if n <= 0])).select("c")
        waiting = [room[r.rank] for r in sizes.select(rank.alias("rank")).distinct().collect() if room[r.rank][1] > 0]  # a row a class
        rows = inside.where(F.col("label").isin([label for label, _ in waiting])).groupBy("label", "c").agg(F.count(F.lit(1)).alias("n"))
        so_far = Scan(rows, ["label"], ["c"]).running({"got": F.col("n")}).rows()
        full = F.coalesce(*[F.when(F.col("label") == label, F.col("got") >= n) for label, n in waiting], F.lit(False))
        limit = so_far.where(full).agg(F.min("c")).first()[0]
        if limit is not None:
            sure = sure.where(F.col("c") < limit)
        sure = sure.join(closed, "c", "left_anti")
    took = inside.join(sure.select("c"), "c", "left_semi")
    counts = took.groupBy("c", "radius").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(None).cast("string"))
    if goals:
        counts = counts.unionByName(took.where("label is not null").groupBy("c", "radius", "label").agg(F.count(F.lit(1)).alias("n")))
    took = _counted(materialise(counts.select("c", "radius", "label", "n"), "accepted"), ledger)
    return took, took.select("c").unionByName(sizes.where("a <= 1").select("c")).unionByName(closed).distinct()


def _alone(left: DataFrame, sizes: DataFrame, ledger: Ledger, goals: Goals | None) -> DataFrame:
    """The first candidate, by counts of its rows at the radii that halving can give."""
    c = sizes.agg(F.min("c")).first()[0]
    own = left.where(F.col("c") == c)
    radius = own.agg(F.first("radius")).first()[0]
    empty = own.select("c", "radius", "label", F.lit(0).cast("long").alias("n")).limit(0)
    if not _offered(ledger, goals, c):
        return empty
    allowed, low = ledger.target - ledger.n_eval + ledger.overshoot, ledger.low
    captured = lambda r: own.where(F.col("d") < r).count()
    if captured(radius) > allowed:
        a, b = low, radius
        for _ in range(HALVINGS):
            middle = (a + b) / 2
            a, b = (a, middle) if captured(middle) > allowed else (middle, b)
        radius = a
    inside = own.where(F.col("d") < radius)
    if inside.count() <= 1:
        return empty
    named = lambda d: d.agg(F.count(F.lit(1)).alias("n"))
    both = named(inside.where("label is not null").groupBy("label")).select("label", "n").unionByName(named(inside).select(F.lit(None).cast("string").alias("label"), "n"))
    return _counted(materialise(both.select(F.lit(c).cast("long").alias("c"), F.lit(radius).alias("radius"), "label", "n"), "accepted"), ledger)


def with_radii(c: DataFrame, everything: DataFrame, train: DataFrame, base: float, config: Config) -> DataFrame:
    """Candidates (id, v) with the radius that density gives them, without those that stored training rows don't leave room for."""
    s = config.spheres
    if s.radius == "fixed" or s.adaptive == "none":
        radii = c.select("id", F.lit(base).alias("radius"))
    else:
        radii = dens.adaptive_radius(c, everything, base, s.adaptive, s.min_radius, s.max_radius, s.scale_factor, config.metric)
    return materialise(validate(materialise(c.join(radii, "id"), "radii"), train, s.min_radius, config.metric), "valid")


def _overshoot(total: int, config: Config) -> int:
    return max(1, int(total * config.splits.tolerance))


def closed_loop(
    p: DataFrame, everything: DataFrame, train: DataFrame, existing: DataFrame, deficit: int, total: int, config: Config, num: int | None = None, base: float | None = None
) -> DataFrame:
    """Anchors (id, v, radius) over unassigned rows p: propose, give radii, validate, then accept in order until the deficit is met."""
    base = base if base is not None else base_radius(p, config)
    c = materialise(propose(p, existing, config, num, filtered=num is None), "proposed")
    ledger = Ledger(deficit, 0, _overshoot(total, config), config.spheres.min_radius)
    return settle_in_turn(c, lambda part: with_radii(part, everything, train, base, config), p, ledger, config)


def class_counts(labels: DataFrame, stored: DataFrame, config: Config) -> DataFrame:
    """(label, total, n_eval, target) of batch and stored rows (label, split), lower case, rare classes first."""
    both = labels.select(F.lower("label").alias("label"), "split").unionByName(stored.select(F.lower("label").alias("label"), "split"))
    counted = both.where("label is not null").groupBy("label").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("split").isin("validation", "test", "val")).alias("n_eval")
    )
    return counted.withColumn("target", F.greatest(F.lit(1), F.floor(F.col("total") * config.splits.eval)).cast("long")).orderBy("total", "label")


def class_aware_loop(
    p: DataFrame, everything: DataFrame, train: DataFrame, existing: DataFrame, stored: DataFrame, target: int, n_eval: int, total: int, config: Config
) -> DataFrame:
    """Anchors (id, v, radius) by class, rare ones first, each filled to four fifths of its target; then without regard to class.

    p: unassigned rows (id, v, label); everything: the batch (id, v, label, split); n_eval of ``target`` eval rows are there already. Any
    free row in a sphere is taken, whatever its class, and counts for the target and for its own class. Classes with fewer than five
    unassigned rows wait for the last pass. Candidates of all classes are proposed at once, and given radii and compared with p as far as they are needed."""
    p, everything = materialise(p.select("id", "v", "label"), "class-rows"), materialise(everything, "class-all")
    base = base_radius(p.select("id", "v"), config)
    ledger = Ledger(target, n_eval, _overshoot(total, config), config.spheres.min_radius)
    sizes = {r.label: r.n for r in p.groupBy(F.lower("label").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    goals: dict[int, Goal] = {}
    parts = []
    for rank, r in enumerate(class_counts(everything, stored, config).collect()):
        ledger.by_class[r.label] = r.n_eval
        goals[rank] = Goal(r.label, r.target)
        n = sizes.get(r.label, 0)
        if n < LEAST_OF_CLASS or not goals[rank].open(ledger):  # what is closed now stays so
            continue
        own = p.where(F.lower("label") == r.label).select("id", "v")
        c = propose(own, existing, config, max(3, int(n * 0.5) * 3), filtered=False)
        number = F.row_number().over(Window.partitionBy(F.lit(rank)).orderBy("id")).cast("long")
        parts.append(c.select((F.lit(rank << RANK) + number).cast("long").alias("id"), "v"))
    found = p.select("id", "v", F.lit(0.0).alias("radius")).limit(0)
    if parts:
        c = materialise(reduce(DataFrame.unionByName, parts), "proposed")
        found = settle_in_turn(c, lambda part: with_radii(part, everything.select("id", "v"), train, base, config), p, ledger, config, goals)
    if not ledger.full:
        inside = spheres.containing(p.select("id", "v"), to_anchors(found, config), config.metric).select("id").distinct()
        rest = materialise(p.select("id", "v").join(inside, "id", "left_anti"), "rest")
        if not rest.isEmpty():
            known = existing.select("id", "v").unionByName(found.select("id", "v"))
            more = closed_loop(rest, everything.select("id", "v"), train, known, target - ledger.n_eval, total, config)
            found = found.unionByName(more.withColumn("id", F.col("id") + F.lit(1 << 62)))
    return found


def to_anchors(placed: DataFrame, config: Config, buffer: float = 0.0, first: int = 0) -> DataFrame:
    """Anchor rows of placed (id, v, radius), numbered in their order from first on."""
    placed = Scan(placed, [], ["id"]).number("_number").rows()
    number = F.col("_number") - 1 + first
    dim = placed.select(F.size("v")).first()
    s = config.spheres
    coin = uniform(config.seed, F.lit("coin"), F.col("anchor_id"))
    shape = spheres.shells(F.col("radius"), dim[0] if dim else 1, s.strategy, config.splits.validation_share, s.nested, coin)
    return placed.withColumn("anchor_id", number.cast("long")).select(
        "anchor_id", F.col("v").alias("center"), F.col("radius").alias("base_radius"), F.lit(float(buffer)).alias("buffer_radius"), shape.alias("shells")
    )
