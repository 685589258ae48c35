"""Logistic regression by Newton steps (M1): each step is one aggregation that
sums the gradient and the weighted Gram matrix over all rows (map-side, d² + d
numbers a task), and a solve of the d × d system on the driver.

The objective is Σ weight · log-loss + ½ · l2 · |coefficients|², the intercept
free, so ``l2 = 1 / C``.  Rows with a null in a feature, the label or the weight are
left out of all sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.session import cut_lineage

#: A step sends (d + 1)(d + 4) / 2 numbers a task.
MAX_FEATURES = 1000
HALVINGS = 6


@dataclass
class LogitFit:
    features: list[str]
    #: Intercept and coefficients after each step, and Σ weight · log-loss before it.
    path: list[tuple[np.ndarray, float]]

    @property
    def coef(self) -> np.ndarray:
        return self.path[-1][0]

    def margin(self) -> Column:
        return _margin(self.coef, self.features)

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin()))


def _margin(beta: np.ndarray, features: list[str]) -> Column:
    out = F.lit(float(beta[0]))
    for b, f in zip(beta[1:], features, strict=True):
        out = out + F.lit(float(b)) * F.col(f)
    return out


def _sums(rows: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Loss, gradient and Gram matrix at ``beta`` over all rows; each task adds up its own."""
    d = len(beta)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + d + len(upper[0]))
        for batch in batches:
            if not batch.num_rows:
                continue
            *xs, y, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack([np.ones(len(y)), *xs])
            z = x @ beta
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            total[0] += np.sum(w * (np.logaddexp(0.0, z) - y * z))
            total[1:d + 1] += (w * (y - p)) @ x
            total[d + 1:] += (x.T @ (x * (w * p * (1.0 - p))[:, None]))[upper]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    got = sorted(rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect())
    if not got:
        return None
    v = np.array([r["v"] for r in got])
    gram = np.zeros((d, d))
    gram[upper] = v[d + 1:]
    return float(v[0]), v[1:d + 1], gram + np.triu(gram, 1).T


def fit_logistic(df: DataFrame, features: list[str], label: str, l2: float = 1.0, weight: str | None = None,
                 max_steps: int = 25, tol: float = 1e-9) -> LogitFit:
    """At most ``max_steps`` Newton steps, each halved (up to ``HALVINGS`` times) while the
    objective rises; ends when no coefficient moves by more than ``tol`` (0: runs all steps)."""
    if len(features) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    rows = df.select(*[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("__y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w")).na.drop()
    rows = cut_lineage(rows)
    d = len(features) + 1
    ridge = np.diag([0.0] + [float(l2)] * (d - 1))

    def value(sums, beta: np.ndarray) -> float:
        return sums[0] + 0.5 * float(beta @ ridge @ beta)

    beta, path = np.zeros(d), []
    now = _sums(rows, beta)
    if now is None:
        return LogitFit(features, [(beta, 0.0)])  # no rows: all coefficients stay 0
    for _ in range(max_steps):
        loss, lack, gram = now
        step = np.linalg.lstsq(gram + ridge, lack - ridge @ beta, rcond=None)[0]
        for _ in range(HALVINGS + 1):
            after = _sums(rows, beta + step)
            if value(after, beta + step) <= value(now, beta) * (1 + 1e-12):
                break
            step = step / 2
        beta, now = beta + step, after
        path.append((beta, loss))
        if tol and np.abs(step).max() <= tol:
            break
    return LogitFit(features, path or [(beta, now[0])])
