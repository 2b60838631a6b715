"""Differentially private logistic regression: Poisson-sampled clipped gradient sums with Gaussian noise.

The accountant bounds the Renyi divergence of the subsampled Gaussian mechanism at integer orders (Mironov, Talwar and
Zhang 2019) and converts it to (epsilon, delta); the noise multiplier is found by bisection. Each step is one Spark
aggregation of p + 1 sums by centre; parameters live on the driver, a small vector for each centre.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..sources.log import EntryLog
from .logit import LogitModel
from .newton import dot

ORDERS = (*range(2, 64), 80, 128, 256, 512)


def renyi_epsilon(rate: float, noise: float, order: int) -> float:
    """One step's Renyi epsilon at an integer order."""
    if rate == 0:
        return 0.0
    if rate == 1:
        return order / (2 * noise**2)
    terms = [math.lgamma(order + 1) - math.lgamma(k + 1) - math.lgamma(order - k + 1) + k * math.log(rate) + (order - k) * math.log(1 - rate) + k * (k - 1) / (2 * noise**2) for k in range(order + 1)]
    top = max(terms)
    return (top + math.log(sum(math.exp(t - top) for t in terms))) / (order - 1)


def composed_epsilon(charges: Iterable[tuple[float, float, int]], delta: float) -> float:
    """What runs of (rate, noise, steps) spend together: Renyi epsilons add up at each order before they are converted."""
    merged = _merged(charges)
    if not any(merged.values()):
        return 0.0
    return min(sum(n * renyi_epsilon(q, s, a) for (q, s), n in merged.items()) + math.log((a - 1) / a) - (math.log(delta) + math.log(a)) / (a - 1) for a in ORDERS)


def _merged(charges: Iterable[tuple[float, float, int]]) -> Counter:
    out: Counter = Counter()
    for q, s, n in charges:
        out[q, s] += n
    return out


def spent_epsilon(rate: float, noise: float, steps: int, delta: float) -> float:
    return composed_epsilon([(rate, noise, steps)], delta)


def noise_multiplier(epsilon: float, delta: float, rate: float, steps: int) -> float:
    low, high = 1e-2, 1.0
    while spent_epsilon(rate, high, steps, delta) > epsilon:
        high *= 2
        if high > 1e6:
            raise ValueError("epsilon is out of reach")
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if spent_epsilon(rate, mid, steps, delta) > epsilon else (low, mid)
    return high


class BudgetExceeded(RuntimeError):
    """A round would spend more than a centre's budget; nothing of it was computed."""


class PrivacyLedger:
    """The privacy budget (epsilon, delta) of every centre, spent by whatever runs there ever are on its rows.

    Entries are appended to a log in a shared folder, a round of a run each, with the rate, noise and steps of each centre.
    A round is charged before anything of it is computed, and refused as a whole if a centre would pass its budget. The same
    round of the same run releases the same numbers (samples and noise follow from seed and round), so it is charged once.
    """

    def __init__(self, spark: SparkSession, path: str, epsilon: float, delta: float):
        self.log, self.epsilon, self.delta = EntryLog(spark, path), epsilon, delta

    def _of(self, entries: list[dict], site: str) -> list[tuple[float, float, int]]:
        return [tuple(e["charges"][site]) for e in entries if site in e["charges"]]

    def spent(self) -> dict[str, float]:
        """Epsilon by centre."""
        entries = self.log.read()
        return {s: composed_epsilon(self._of(entries, s), self.delta) for s in sorted({s for e in entries for s in e["charges"]})}

    def charge(self, run: str, round: int, charges: dict[str, tuple[float, float, int]]) -> bool:
        """Charge (rate, noise, steps) by centre; whether that was new."""
        own = {s: list(c) for s, c in charges.items()}

        def decide(entries: list[dict]) -> dict | None:
            known = [e for e in entries if (e["run"], e["round"]) == (run, round)]
            if known:
                if known[0]["charges"] != own:
                    raise ValueError(f"round {round} of run {run!r} was charged with other parameters")
                return None
            for site, charge in charges.items():
                total = composed_epsilon([*self._of(entries, site), charge], self.delta)
                if total > self.epsilon * (1 + 1e-9):
                    raise BudgetExceeded(f"{site}: round {round} of run {run!r} would spend {total:.4g} of {self.epsilon:.4g}")
            return {"run": run, "round": round, "charges": own}

        return self.log.append(decide)


@dataclass(frozen=True)
class PrivateState:
    """What a private fit needs to go on: the rounds done and the shared parameters. Noise and samples follow from the
    seed and the round, so a fit that stops and goes on equals one that does not, and spends the same budget."""

    round: int
    coef: tuple[float, ...]

    def save(self, spark: SparkSession, path: str) -> None:
        """Append to a log of states in a shared folder."""
        EntryLog(spark, path).append(lambda _: {"round": self.round, "coef": self.coef})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PrivateState:
        """The last state of a log."""
        own = EntryLog(spark, path).read()[-1]
        return cls(own["round"], tuple(own["coef"]))


def fit_private_logit(df: DataFrame, features: Sequence[str], label: str, key: str, epsilon: float, delta: float, clip: float, batch: int = 32, updates: int = 20, rounds: int = 5, rate: float = 0.5, center: str | None = None, seed: int = 3, state: PrivateState | None = None, until: int | None = None, ledger: PrivacyLedger | None = None, run: str = "run") -> LogitModel:
    """ledger: charged for each round under the name of the run before the round is computed. state: go on from it; until: stop after so many of the `rounds`, whose number the noise is calibrated for.

    Each round every centre makes `updates` private steps from the shared parameters; the server then averages the
    parameters by rows. Steps number exactly updates * rounds, as the noise is calibrated for. An empty batch moves by
    noise alone. Sampling is a hash of the row's key and the step, so it needs no state."""
    names = [f"x{k}" for k in range(len(features) + 1)]
    site = F.col(center).cast("string") if center else F.lit("all")
    rows = df.select(F.col(key).alias("key"), site.alias("site"), F.col(label).cast("double").alias("y"), F.lit(1.0).alias("x0"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features, 1)]).na.drop().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r["site"]: r["n"] for r in rows.groupBy("site").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a centre
        sample = {s: min(1.0, batch / n) for s, n in sizes.items()}
        noise = {s: noise_multiplier(epsilon, delta, q, updates * rounds) for s, q in sample.items()}
        shared = np.array(state.coef) if state else np.zeros(len(names))
        last = rounds if until is None else min(until, rounds)
        for r in range(state.round if state else 0, last):
            if ledger:
                ledger.charge(run, r, {s: (sample[s], noise[s], updates) for s in sorted(sizes)})
            rng = np.random.default_rng([seed, r])
            own = {s: shared.copy() for s in sizes}
            for u in range(updates):
                pick = F.lit(None)
                eta = F.lit(None).cast("double")
                for s, q in sample.items():
                    pick = F.when(F.col("site") == s, F.lit(q)).otherwise(pick)
                    eta = F.when(F.col("site") == s, dot([F.col(n) for n in names], own[s])).otherwise(eta)
                draw = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(r * updates + u)), F.lit(1 << 53)).cast("double") / float(1 << 53)
                slope = 1 / (1 + F.exp(-eta)) - F.col("y")
                length = F.abs(slope) * F.sqrt(sum((F.col(n) * F.col(n) for n in names[1:]), F.col("x0") * F.col("x0")))
                cut = slope * F.least(F.lit(1.0), F.try_divide(F.lit(clip), length))
                sums = rows.where(draw < pick).groupBy("site").agg(*[F.sum(F.coalesce(cut, F.lit(0.0)) * F.col(n)).alias(n) for n in names])
                got = {row["site"]: np.array([row[n] for n in names]) for row in sums.collect()}
                for s in sorted(sizes):
                    step = got.get(s, np.zeros(len(names))) + rng.normal(0, noise[s] * clip, len(names))
                    own[s] -= rate * step / (sample[s] * sizes[s])
            shared = sum(own[s] * sizes[s] for s in sorted(sizes)) / sum(sizes.values())
        return LogitModel(tuple(features), tuple(float(b) for b in shared), updates * last, last == rounds)
    finally:
        rows.unpersist()
