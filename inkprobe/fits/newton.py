"""Logistic regression of many runs by Newton steps: one job gives all of them their next step."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkprobe.fits.table import class_counts, matrix, runs_of, summed

# Features up to which the matrix of second derivatives is built (8 MB a run); wider ones go to a solver without it.
WIDEST = 1024


@dataclass
class Linear:
    """Weights and, last, the intercept."""

    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        return np.exp(-np.logaddexp(0, -z))


def _partials(train: DataFrame, at: dict[int, np.ndarray], class_weight: dict[int, tuple[float, float]]) -> DataFrame:
    """For each task and run: loss, gradient and second derivatives of the unpenalised objective at the run's weights."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = matrix(batch.column(3)), batch.column(1).to_numpy()
            x = np.hstack([x, np.ones((len(x), 1))])
            for number, rows in runs_of(batch):
                if number not in at:
                    continue
                a, t = x[rows], y[rows]
                s = np.where(t == 1, class_weight[number][1], class_weight[number][0])
                z = a @ at[number]
                p = np.exp(-np.logaddexp(0, -z))
                loss = (s * (np.logaddexp(0, z) - t * z)).sum()
                part = np.concatenate([[loss], a.T @ (s * (p - t)), (a.T @ (a * (s * p * (1 - p))[:, None])).ravel()])
                total[number] = total[number] + part if number in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["run", "values"])

    return train.select("key", "label", "runs", "x").mapInArrow(run, "run int, values binary")


def fit_logreg(train: DataFrame, width: int, balanced: bool = True, strength: float = 1.0, most: int = 100, tolerance: float = 1e-9) -> dict[int, Linear]:
    """Weights that minimise |w|^2 / 2 + ``strength`` * (weighted log losses), the intercept free of penalty, for every run.

    With ``balanced``, a row weighs n / (classes * rows of its class) within its run. All runs take their steps in the same job, and a run that has
    converged drops out. A step that would raise the objective is halved, so the minimum is reached from anywhere. The driver gets one vector of
    (width + 1)^2 + width + 2 numbers a run and step, whatever number of rows there is.
    """
    counts = class_counts(train)
    weight = {}
    for run, own in counts.items():
        n = sum(own.values())
        weight[run] = tuple(n / (len(own) * own[c]) if balanced and c in own else 1.0 for c in (0, 1))
    penalty = np.r_[np.ones(width), 0.0] / strength
    at = {run: np.zeros(width + 1) for run in counts}
    best: dict[int, tuple[np.ndarray, float]] = {}
    step: dict[int, np.ndarray] = {}
    done: dict[int, Linear] = {}
    for _ in range(most):
        sums = summed(_partials(train, at, weight), lambda key, total: [(key[0], total.tobytes())], "run int, values binary", 1).collect()
        for row in sums:
            run, total = row.run, np.frombuffer(row["values"])
            w, d = at[run], width + 1
            loss = total[0] + (penalty * w * w).sum() / 2
            if run in best and not loss <= best[run][1] + 1e-12 * abs(best[run][1]):
                step[run] = step[run] / 2
            else:
                best[run] = (w, loss)
                second = total[1 + d :].reshape(d, d) + np.diag(penalty)
                gradient = total[1 : 1 + d] + penalty * w
                step[run] = -np.linalg.lstsq(second, gradient, rcond=None)[0]
            at[run] = best[run][0] + step[run]
            if np.abs(step[run]).max() <= tolerance * (1 + np.abs(w).max()):
                done[run] = Linear(at[run] if np.isfinite(at[run]).all() else best[run][0])
                del at[run]
        if not at:
            return done
    warnings.warn(f"logistic regression: {len(at)} runs stopped after {most} steps without converging", stacklevel=2)
    return done | {run: Linear(best[run][0]) for run in at}
