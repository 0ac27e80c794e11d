"""Corrections for the number of variants tried. The matrix of months by variants is small; it is handled on the driver."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingdelta.operators.stats import correlation

NORMAL = NormalDist()


def expected_max_sharpe(variance: float, n: int) -> float:
    """Expected largest of n Sharpe ratios without skill."""
    if n < 2:
        return 0.0
    g = 0.5772156649015329
    return math.sqrt(variance) * ((1 - g) * NORMAL.inv_cdf(1 - 1 / n) + g * NORMAL.inv_cdf(1 - 1 / (n * math.e)))


def deflated_sharpe(sr: float, threshold: float, n: int, skew: float, kurtosis: float) -> float:
    """Probability that the true Sharpe ratio per period is above threshold; kurtosis is 3 for a normal."""
    spread = 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr
    return NORMAL.cdf((sr - threshold) * math.sqrt(n - 1) / math.sqrt(spread)) if spread > 0 else float("nan")


def common_months(trials: DataFrame, variant: str = "variant", month: str = "month") -> DataFrame:
    """The rows of the months that all variants have."""
    whole = trials.agg(F.count_distinct(variant).alias("n_variants"))
    kept = trials.groupBy(month).agg(F.count_distinct(variant).alias("n")).join(F.broadcast(whole), F.col("n") == F.col("n_variants")).select(month)  # one row
    return trials.join(kept, month, "left_semi")


def participation_ratio(trials: DataFrame, variant: str = "variant", month: str = "month", r: str = "ls") -> DataFrame:
    """Effective number of variants: N squared over the sum of the squared correlations, from pairwise sums."""
    other = trials.select(F.col(variant).alias("other"), month, F.col(r).alias("other_ret"))
    pairs = trials.join(other, month).groupBy(variant, "other").agg(correlation(r, "other_ret").alias("c"))
    return pairs.agg((F.pow(F.countDistinct(variant).cast("double"), F.lit(2.0)) / F.sum(F.col("c") * F.col("c"))).alias("n_eff"))


def cscv(matrix: np.ndarray, splits: int = 16) -> dict:
    """Combinatorially symmetric cross-validation of a months x variants matrix: n_combinations, pbo (the share of halves
    whose best variant ranks in the lower half of the other half) and prob_oos_loss. Blocks differ by a month at most."""
    months, n = matrix.shape
    while splits > 2 and months < 2 * splits:
        splits -= 2
    blocks = np.array_split(np.arange(months), splits)
    sums = np.array([matrix[b].sum(axis=0) for b in blocks])
    squares = np.array([(matrix[b] ** 2).sum(axis=0) for b in blocks])
    sizes = np.array([len(b) for b in blocks])

    def sharpe(mask):
        k = sizes[mask].sum()
        mean = sums[mask].sum(axis=0) / k
        return mean / np.sqrt(np.maximum((squares[mask].sum(axis=0) - k * mean**2) / (k - 1), 1e-300))

    low = loss = total = 0
    for chosen in combinations(range(splits), splits // 2):
        mask = np.zeros(splits, dtype=bool)
        mask[list(chosen)] = True
        best, out = int(np.argmax(sharpe(mask))), sharpe(~mask)
        rank = (out < out[best]).sum() + ((out == out[best]).sum() + 1) / 2
        low += rank / (n + 1) <= 0.5
        loss += out[best] < 0
        total += 1
    return {"n_combinations": total, "pbo": low / total, "prob_oos_loss": loss / total}


def report(trials: DataFrame, variant: str = "variant", month: str = "month", r: str = "ls", splits: int = 16) -> dict:
    """The best variant on the months that all variants have, its deflated Sharpe ratios and CSCV figures. The table of
    months by variants comes to the driver: some hundred months by some hundred variants."""
    wide = common_months(trials, variant, month).groupBy(month).pivot(variant).agg(F.first(r)).dropna().orderBy(month).toPandas().set_index(month)
    x = wide.to_numpy(float)
    sr = x.mean(axis=0) / x.std(axis=0, ddof=1)
    best = int(np.argmax(sr))
    z = (x[:, best] - x[:, best].mean()) / x[:, best].std()
    corr = np.corrcoef(x.T)
    n_eff = max(1, round(len(sr) ** 2 / (np.atleast_2d(corr) ** 2).sum()))
    out = {"n_trials": len(sr), "n_eff": n_eff, "best": wide.columns[best], "best_sharpe": float(sr[best] * math.sqrt(12)), "median_sharpe": float(np.median(sr) * math.sqrt(12)), "n_months": len(x)}
    for name, n in (("raw", len(sr)), ("eff", n_eff)):
        top = expected_max_sharpe(float(sr.var(ddof=1)), n)
        out |= {f"expected_max_{name}": top * math.sqrt(12), f"dsr_{name}": deflated_sharpe(float(sr[best]), top, len(x), float((z**3).mean()), float((z**4).mean()))}
    return out | cscv(x, splits)
