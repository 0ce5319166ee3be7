"""Domains of a matrix: boundaries by modularity, states by a Gaussian hidden Markov model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a chromosome that one task takes as a dense matrix at most.
MOST_BINS = 6_000


def segment_scores(matrix: np.ndarray, gamma: float, good: np.ndarray) -> np.ndarray:
    """Modularity of every segment: s[i, j] sums, over the pairs of good bins in [i, j), contacts less ``gamma`` times what degrees expect, by all contacts."""
    a = np.where(good[:, None] & good[None], matrix, 0.0)
    total = a.sum()
    n = len(a)
    if not total:
        return np.zeros((n + 1, n + 1))
    degree = a.sum(0)
    b = (a - gamma * np.outer(degree, degree) / total) / total
    c = np.zeros((n + 1, n + 1))
    c[1:, 1:] = b.cumsum(0).cumsum(1)
    d = np.diag(c)
    return d[None, :] + d[:, None] - c - c.T  # squares [i, j) x [i, j)


def boundary_marginals(scores: np.ndarray, beta: float) -> np.ndarray:
    """Probability of a boundary at 0 to n when a segmentation weighs exp(beta * the sum of its segments' scores)."""
    n = len(scores) - 1
    ahead, back = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        ahead[j] = _log_sum(ahead[:j] + beta * scores[:j, j])
    for i in range(n - 1, -1, -1):
        back[i] = _log_sum(back[i + 1 :] + beta * scores[i, i + 1 :])
    return np.exp(ahead + back - ahead[n])


def _log_sum(x: np.ndarray) -> float:
    top = x.max()
    return float(top + np.log(np.exp(x - top).sum()))


def modularity_boundaries(pixels: DataFrame, resolution: int, beta: float = 10_000.0, gamma: float = 2.0, good_bins: int = 100, keys: list[str] | None = None) -> DataFrame:
    """Per bin border: keys, chrom, pos and the probability of a boundary.  Bins with more than ``good_bins`` contacting bins count.

    A chromosome is a dense matrix in one task, so it may have MOST_BINS bins; more fail.
    """
    keys = ["cell"] if keys is None else keys
    by = [*keys, "chrom"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["bin2"].max() // resolution) + 1
        if n > MOST_BINS:
            raise ValueError(f"{n} bins; a chromosome may have {MOST_BINS}")
        m = np.zeros((n, n))
        i, j = (pdf["bin1"] // resolution).to_numpy(), (pdf["bin2"] // resolution).to_numpy()
        np.add.at(m, (i, j), pdf["value"].to_numpy(float))
        m = np.triu(m) + np.triu(m, 1).T
        p = boundary_marginals(segment_scores(m, gamma, (m != 0).sum(0) > good_bins), beta)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * (n + 1) for k in by}, "pos": np.arange(n + 1) * resolution, "probability": p})

    schema = ", ".join([*(f"`{k}` string" for k in by), "pos bigint", "probability double"])
    return pixels.select(*by, "bin1", "bin2", "value").groupBy(*by).applyInPandas(run, schema)


class GaussianHmm:
    """States that emit diagonal Gaussians; fitted by expectation-maximisation from a start by quantiles of the first feature."""

    def __init__(self, states: int, rounds: int = 100, tolerance: float = 1e-6):
        self.states, self.rounds, self.tolerance = states, rounds, tolerance

    def _logs(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.mean) ** 2 / self.var
        return -0.5 * (z + np.log(2 * np.pi * self.var)).sum(2)

    def fit(self, x: np.ndarray) -> GaussianHmm:
        k, n = self.states, len(x)
        groups = np.array_split(np.argsort(x[:, 0], kind="stable"), k)
        floor = 1e-6 * x.var(0) + 1e-12
        self.mean = np.array([x[g].mean(0) for g in groups])
        self.var = np.array([x[g].var(0) for g in groups]) + floor
        self.start = np.full(k, 1 / k)
        self.step = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)) if k > 1 else np.ones((1, 1))
        before = -np.inf
        for _ in range(self.rounds):
            b = self._logs(x)
            shift = b.max(1, keepdims=True)
            e = np.exp(b - shift)
            ahead, back, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
            for t in range(n):
                ahead[t] = (self.start if not t else ahead[t - 1] @ self.step) * e[t]
                scale[t] = ahead[t].sum()
                ahead[t] /= scale[t]
            for t in range(n - 2, -1, -1):
                back[t] = self.step @ (e[t + 1] * back[t + 1]) / scale[t + 1]
            gamma = ahead * back
            gamma /= gamma.sum(1, keepdims=True)
            moves = (ahead[:-1].T @ (e[1:] * back[1:] / scale[1:, None])) * self.step
            self.start = gamma[0]
            self.step = moves / np.maximum(moves.sum(1, keepdims=True), 1e-300)
            weight = np.maximum(gamma.sum(0), 1e-300)[:, None]
            self.mean = gamma.T @ x / weight
            self.var = np.stack([gamma[:, s] @ (x - self.mean[s]) ** 2 for s in range(k)]) / weight + floor
            self.likelihood = float(np.log(scale).sum() + shift.sum())
            if self.likelihood - before < self.tolerance:
                break
            before = self.likelihood
        return self

    def states_of(self, x: np.ndarray) -> np.ndarray:
        """The most likely path; states are numbered by their mean of the first feature."""
        b, log = self._logs(x), lambda p: np.log(np.maximum(p, 1e-300))
        best, came = log(self.start) + b[0], np.zeros((len(x), self.states), int)
        for t in range(1, len(x)):
            way = best[:, None] + log(self.step)
            came[t] = way.argmax(0)
            best = way.max(0) + b[t]
        path = [int(best.argmax())]
        for t in range(len(x) - 1, 0, -1):
            path.append(int(came[t, path[-1]]))
        rank = np.argsort(np.argsort(self.mean[:, 0]))
        return rank[np.array(path[::-1])]


def hidden_states(values: DataFrame, states: int = 3, rounds: int = 100) -> DataFrame:
    """chrom, pos, mean, std and state, from values (cell, chrom, pos, value): a model for each chromosome over its loci in order."""
    stats = values.groupBy("chrom", "pos").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std")).where("mean IS NOT NULL")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = pdf[["mean", "std"]].to_numpy(float)
        k = min(states, len(x))
        return pdf.assign(state=GaussianHmm(k, rounds).fit(x).states_of(x))

    return stats.groupBy("chrom").applyInPandas(run, "chrom string, pos bigint, mean double, std double, state bigint")
