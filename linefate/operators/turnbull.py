"""Turnbull's estimator for interval-censored lifetimes, and a cluster bootstrap round it.

Lifetimes reach the fit grouped and weighted, so a group's input is bounded by its distinct lifetimes. Each fit is one
grouped task; bootstrap replicates are tasks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LEVEL
from . import survival

TOLERANCE = 1e-12
MAX_ITERATIONS = 100_000
#: Iterations before a fit turns to Newton steps, the most of these, and how near to 1 the gains should and must come.
HEAD, MAX_NEWTON, NEWTON_TOLERANCE, NEWTON_ENOUGH = 200, 100, 1e-11, 1e-7
#: Intervals that come into play in one step, and the most in play; a fit that needs more goes on without Newton steps.
AT_ONCE, MOST_IN_PLAY = 300, 4000
MASK = (1 << 64) - 1
DRAWN_AT_ONCE = 1 << 22


class Estimate:
    """Mass on the innermost intervals (start, end], sorted and disjoint."""

    def __init__(self, start: np.ndarray, end: np.ndarray, mass: np.ndarray, iterations: int = 0, converged: bool = True) -> None:
        self.start, self.end, self.mass, self.iterations, self.converged = start, end, mass, iterations, converged

    def survival(self, t: float) -> float:
        """Chance to survive past t; an interval's mass is spread evenly over it, an endless one never loses its mass."""
        if not len(self.mass):
            return 0.0
        with np.errstate(invalid="ignore", divide="ignore"):
            part = np.where(~np.isfinite(self.end) | (t <= self.start), 1.0, np.where(t >= self.end, 0.0, (self.end - t) / (self.end - self.start)))
        return float(np.clip((self.mass * part).sum(), 0.0, 1.0))

    def corners(self) -> list[float]:
        ends = np.concatenate((self.start, self.end))
        return np.unique(ends[np.isfinite(ends)]).tolist()

    def quantile(self, level: float) -> float | None:
        """The first time at which survival falls to ``level``, or None."""
        before: tuple[float, float] | None = None
        corners = self.corners()
        beyond = np.concatenate((np.cumsum(self.mass[::-1])[::-1], [0.0]))[np.searchsorted(self.end, corners, side="right")]
        # only the corners round the crossing are looked at one by one; sums in another order differ by less than the margin
        near = int(np.argmax(np.append(beyond <= level + 1e-9, True)))
        for t in corners[max(near - 1, 0) :]:
            s = self.survival(t)
            if s <= level:
                if before and before[1] > s:
                    t = before[0] + (t - before[0]) * (before[1] - level) / (before[1] - s)
                return max(t, 0.0)
            before = (t, s)
        return None

    def median(self) -> float | None:
        return self.quantile(0.5)

    def curve(self) -> list[tuple[float, float]]:
        return [(t, self.survival(t)) for t in sorted({0.0, *self.corners()})]


def intervals(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value = np.concatenate((left, right))
    is_right = np.concatenate((np.zeros(len(left), dtype=bool), np.ones(len(right), dtype=bool)))
    order = np.lexsort((~is_right, value))
    value, is_right = value[order], is_right[order]
    at = np.flatnonzero(is_right[1:] & ~is_right[:-1])
    return value[at], value[at + 1]


class Lifetimes:
    """Weighted lifetimes as runs of the innermost intervals they contain, equal runs once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.m, self.total = len(start), weight.sum()
        runs = np.searchsorted(start, left, side="left") * (self.m + 1) + np.searchsorted(end, right, side="right")
        runs, which = np.unique(runs, return_inverse=True)
        self.weight = np.bincount(which.ravel(), weights=weight)
        self.first, self.after = runs // (self.m + 1), runs % (self.m + 1)

    def covered(self, mass: np.ndarray) -> np.ndarray:
        prefix = np.concatenate(([0.0], np.cumsum(mass)))
        return prefix[self.after] - prefix[self.first]

    def gain(self, covered: np.ndarray) -> np.ndarray:
        """By what an iteration multiplies each mass: 1 where there is mass at the maximum, at most 1 elsewhere."""
        ok = covered > 0
        share = np.divide(self.weight, covered, out=np.zeros_like(covered), where=ok)
        spread = np.bincount(self.first, weights=share, minlength=self.m + 1) - np.bincount(self.after, weights=share, minlength=self.m + 1)
        return np.cumsum(spread)[: self.m] / self.total

    def curvature(self, covered: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Negative second derivatives of the log-likelihood by the masses of the intervals ``at``."""
        s = len(at)
        first, after = np.searchsorted(at, self.first), np.searchsorted(at, self.after)
        held = np.bincount(first * (s + 1) + after, weights=self.weight / covered**2, minlength=(s + 1) ** 2).reshape(s + 1, s + 1)
        upper = np.triu(held.cumsum(axis=0)[:, ::-1].cumsum(axis=1)[:, ::-1][:s, 1:])
        return upper + np.triu(upper, 1).T


def least(h: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The x of no negative part where x'hx / 2 - b'x is least, by block pivoting from the free parts of ``x``."""
    free, fewest, patience, slack = x > 0, len(b) + 1, 3, 1e-10 * np.abs(b).max()
    for _ in range(10 * len(b) + 10):
        x, at = np.zeros(len(b)), np.flatnonzero(free)
        x[at] = np.linalg.solve(h[np.ix_(at, at)], b[at])
        wrong = np.where(free, x < 0, h @ x - b < -slack)
        n = int(wrong.sum())
        if not n:
            break
        if n < fewest:
            fewest, patience = n, 3
        else:
            patience -= 1
        if patience < 0:  # one at a time can't go round in circles
            wrong[: np.flatnonzero(wrong)[-1]] = False
        free = free ^ wrong
    return np.maximum(x, 0.0)


def seeds(lives: Lifetimes, mass: np.ndarray) -> np.ndarray:
    """``mass`` gathered on its highest peaks, and on one interval of each lifetime that holds none of these."""
    rises = np.concatenate(([True], mass[1:] > mass[:-1]))
    hill = np.cumsum(rises & np.concatenate(([True], ~rises[:-1])))
    order = np.lexsort((-mass, hill))
    peaks = order[np.concatenate(([True], hill[order][1:] != hill[order][:-1]))]
    held = np.bincount(hill - 1, weights=mass)
    high = np.argsort(-held, kind="stable")[:AT_ONCE]
    out, some = np.zeros(lives.m), 0.1 * lives.weight / lives.total  # less would be lost in the sums of others
    out[peaks[high]] = np.maximum(held[high], some.min())
    bare = np.flatnonzero(lives.covered((out > 0).astype(float)) == 0)
    last = -1
    for i in bare[np.argsort(lives.after[bare], kind="stable")]:
        if last < lives.first[i]:
            last = lives.first[i] + int(np.argmax(mass[lives.first[i] : lives.after[i]]))
            out[last] = max(mass[last], some[i])
    return out


def maximum(lives: Lifetimes, mass: np.ndarray) -> np.ndarray | None:
    """The masses of greatest likelihood, by Newton steps on the intervals in play; None if they aren't found.

    In play are the intervals with mass and, of those between two of them, the one of greatest gain above 1. There is one
    such point only: a lifetime ends at the end of each interval, so no two distributions cover all lifetimes alike.
    """
    n, mass = lives.total, seeds(lives, mass)
    covered = lives.covered(mass)
    if not (covered > 0).all():
        return None
    value = lambda mass, covered: float((lives.weight * np.log(covered)).sum()) - n * float(mass.sum())
    now = value(mass, covered)
    for _ in range(MAX_NEWTON):
        gain, has = lives.gain(covered), np.flatnonzero(mass > 0)
        off = max(float(gain.max()) - 1.0, float(np.abs(gain[has] - 1.0).max()))
        if off <= NEWTON_TOLERANCE:
            break
        order = np.lexsort((-gain, np.searchsorted(has, np.arange(lives.m), side="right")))
        between = np.searchsorted(has, order, side="right")
        best = order[np.concatenate(([True], between[1:] != between[:-1]))]
        best = best[gain[best] > 1.0]
        at = np.union1d(has, best[np.argsort(-gain[best], kind="stable")[:AT_ONCE]])
        if len(at) > MOST_IN_PLAY:
            return None
        h = lives.curvature(covered, at)
        ridge = 1e-12 * np.diag(h)
        try:
            to = least(h + np.diag(ridge), n * (2.0 * gain[at] - 1.0) + ridge * mass[at], mass[at])
        except np.linalg.LinAlgError:
            return None
        step = -mass
        step[at] += to
        slope, part = n * float(((gain - 1.0) * step).sum()), 1.0
        while part > 1e-10:
            tried = np.maximum(mass + part * step, 0.0)
            reached = lives.covered(tried)
            if (reached > 0).all() and (then := value(tried, reached)) >= now + 0.1 * part * slope - 1e-13 * abs(now):
                break
            part /= 2.0
        else:
            break
        mass, covered, now = tried, reached, then
    gain = lives.gain(covered)
    if max(float(gain.max()) - 1.0, float(np.abs(gain[mass > 0] - 1.0).max())) > NEWTON_ENOUGH:
        return None
    return mass / mass.sum()


def fit(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> Estimate:
    """Self-consistency iterations until the log-likelihood no longer rises. Lifetimes of no weight don't count.

    A fit that takes longer than ``HEAD`` iterations goes on from the maximum these would come to; the same rule ends it.
    """
    use = weight > 0
    left, right, weight = left[use], right[use], weight[use]
    start, end = intervals(left, right)
    m = len(start)
    if not m:
        return Estimate(start, end, np.empty(0))
    lives = Lifetimes(left, right, weight, start, end)
    mass, before = np.full(m, 1.0 / m), -np.inf
    for step in range(1, MAX_ITERATIONS + 1):
        if step == HEAD and (found := maximum(lives, mass)) is not None:
            mass, before = found, -np.inf
        covered = lives.covered(mass)
        ok = covered > 0
        likelihood = float((lives.weight[ok] * np.log(covered[ok])).sum())
        if likelihood - before <= TOLERANCE * max(abs(likelihood), 1.0):
            return Estimate(start, end, mass, step, True)
        before = likelihood
        mass = mass * lives.gain(covered)
    return Estimate(start, end, mass, MAX_ITERATIONS, False)


def _columns(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(["left", "right"])
    return pdf["left"].to_numpy(float), pdf["right"].to_numpy(float), pdf["weight"].to_numpy(float)


def estimates(observed: DataFrame, *by: str) -> DataFrame:
    """(by, start, end, mass) of each group of lifetimes."""
    schema = observed.select(*by).schema.add("start", "double").add("end", "double").add("mass", "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = fit(*_columns(pdf))
        return pd.DataFrame({b: [pdf[b].iloc[0]] * len(e.mass) for b in by} | {"start": e.start, "end": e.end, "mass": e.mass})

    # groups are small in bytes and long to fit: by a number of its own the shuffle is not put together into one task
    tasks = int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return survival.grouped(observed, *by).repartition(tasks, *by).groupBy(*by).applyInPandas(run, schema)


def survival_at(masses: DataFrame, ages: Sequence[float], *by: str) -> DataFrame:
    """(by, age, survival) at a short list of ages, from (by, start, end, mass)."""
    held = masses.withColumn("age", F.explode(F.array(*[F.lit(float(a)) for a in ages])))
    beyond = F.when((F.col("end") == float("inf")) | (F.col("age") <= F.col("start")), 1.0).when(F.col("age") >= F.col("end"), 0.0).otherwise((F.col("end") - F.col("age")) / (F.col("end") - F.col("start")))
    return held.groupBy(*by, "age").agg(F.least(F.greatest(F.sum(F.col("mass") * beyond), F.lit(0.0)), F.lit(1.0)).alias("survival"))


def medians(observed: DataFrame, by: str) -> DataFrame:
    """(by, n, deaths, median, iterations, converged) of each group's fit; a median not reached is null."""
    schema = observed.select(by).schema.add("n", "double").add("deaths", "double").add("median", "double").add("iterations", "integer").add("converged", "boolean")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, weight = _columns(pdf)
        e = fit(left, right, weight)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [weight.sum()], "deaths": [weight[np.isfinite(right)].sum()], "median": [e.median()], "iterations": [e.iterations], "converged": [e.converged]})

    return survival.grouped(observed, by).groupBy(by).applyInPandas(run, schema)


def stream(seed: int) -> Iterator[int]:
    """Reproducible 64-bit numbers (SplitMix64)."""
    state = seed & MASK
    while True:
        state = (state + 0x9E3779B97F4A7C15) & MASK
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        yield z ^ (z >> 31)


def draws(seed: int, replicate: int, n: int) -> np.ndarray:
    """How often each of n clusters is drawn in one replicate of n draws."""
    state = (seed ^ (replicate * 0xD1B54A32D192ED03)) & MASK
    times, size = np.zeros(n, dtype=np.int64), np.uint64(n)
    for at in range(0, n, DRAWN_AT_ONCE):
        # the numbers of stream() from here on, by their place
        z = np.arange(at + 1, min(at + DRAWN_AT_ONCE, n) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(state)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
        # z * n >> 64 in two halves, as n is below 2 ** 32
        low = (z & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32)
        times += np.bincount((((z >> np.uint64(32)) * size + low) >> np.uint64(32)).astype(np.int64), minlength=n)
    return times


def replicates(observed: DataFrame, by: str, cluster: str, order: str, statistics: Callable[[Estimate], list[float | None]], width: int, n_replicates: int, seed: int, chunk: int = 16) -> DataFrame:
    """(by, replicate, k, value): each statistic of each refit. Clusters are numbered by first appearance in ``order``.

    A group's lifetimes are grouped by cluster and packed into one row first; a task takes ``chunk`` replicates of one group.
    """
    weighted = observed.groupBy(by, cluster, "left", "right").agg(F.count(F.lit(1)).alias("weight"), F.min(order).alias("first"))
    parts = (n_replicates - 1) // chunk + 1
    packed = observed.select(by).schema
    for name in ("pairs", "number", "pair", "weight"):
        packed = packed.add(name, "binary")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pdf[cluster], use_na_sentinel=False, sort=True)
        lead = pdf["first"].groupby(codes).min().sort_values(kind="stable")
        number = np.empty(len(names), dtype=np.int32)
        number[lead.index] = np.arange(len(names))
        left, right = pdf["left"].to_numpy(float), pdf["right"].to_numpy(float)
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
        row = {by: pdf[by].iloc[0], "pairs": np.stack((left[new], right[new])).tobytes(), "number": number[codes][order].tobytes(), "pair": (np.cumsum(new) - 1).astype(np.int32).tobytes(), "weight": pdf["weight"].to_numpy(float)[order].tobytes(), "clusters": len(names)}
        return pd.DataFrame([row])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                left, right = np.frombuffer(row["pairs"]).reshape(2, -1)
                number, pair, weight = np.frombuffer(row["number"], np.int32), np.frombuffer(row["pair"], np.int32), np.frombuffer(row["weight"])
                rows, at = [], row["part"] * chunk
                for replicate in range(at, min(at + chunk, n_replicates)):
                    times = draws(seed, replicate, row["clusters"])
                    total = np.bincount(pair, weights=weight * times[number], minlength=len(left))
                    rows += [(row[by], replicate, k, v) for k, v in enumerate(statistics(fit(left, right, total)))]
                yield pd.DataFrame(rows, columns=[by, "replicate", "k", "value"])

    groups = weighted.groupBy(by).applyInPandas(pack, packed.add("clusters", "long"))
    dealt = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts)
    return dealt.mapInPandas(run, observed.select(by).schema.add("replicate", "integer").add("k", "integer").add("value", "double"))


def bands(found: DataFrame, by: str, n_replicates: int, level: float = LEVEL) -> DataFrame:
    """(by, k, low, high): order statistics of each value over the replicates; a value beyond the data sorts last, as null."""
    tail = (1.0 - level) / 2.0
    low = min(int(tail * n_replicates), n_replicates - 1)
    high = min(max(int(np.ceil((1.0 - tail) * n_replicates)) - 1, 0), n_replicates - 1)
    # as many values as there are replicates, a bounded number
    values = F.sort_array(F.collect_list(F.coalesce("value", F.lit(float("inf")))))
    pick = lambda i: F.nullif(F.element_at(F.col("v"), i + 1), F.lit(float("inf")))
    return found.groupBy(by, "k").agg(values.alias("v")).select(by, "k", pick(low).alias("low"), pick(high).alias("high"))
