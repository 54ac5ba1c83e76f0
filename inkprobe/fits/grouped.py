"""Classifiers by name, fitted for all runs at once."""

from __future__ import annotations

import json
import pickle
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkprobe.fits.boosting import Booster, BoostSpec, fit_boosters
from inkprobe.fits.forests import ForestSpec, fit_forests
from inkprobe.fits.isotonic import Curve, fit_isotonic
from inkprobe.fits.networks import NetworkSpec, fit_networks
from inkprobe.fits.newton import WIDEST, Linear, fit_logreg
from inkprobe.fits.table import scored
from inkprobe.operators.sampling import stratified_kfold
from inkprobe.session import stage


@dataclass
class Calibrated:
    """Mean of boosters, each through the curve fitted on the rows that it didn't learn from."""

    members: list[tuple[Booster, Curve]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum(curve(model.scores(x)) for model, curve in self.members) / len(self.members)


@dataclass
class Scaled:
    """A model behind ``(x - mean) / std`` of the population; a feature without variance becomes 0."""

    mean: np.ndarray
    std: np.ndarray
    model: Any

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.model.scores(np.where(self.std > 0, (x - self.mean) / np.where(self.std > 0, self.std, 1), 0.0))


def _width(train: DataFrame) -> int:
    return train.select(F.max(F.size("x"))).first()[0] or 0


def _logreg(train: DataFrame, seed: int, balanced: bool = True, **options) -> dict[int, Linear]:
    width = _width(train)
    if width <= WIDEST:
        return fit_logreg(train, width, balanced, **options)
    # Too wide for second derivatives: one run after another by the solver without them.
    from pyspark.ml.functions import array_to_vector

    from inkprobe.plans.classifiers import fit_classifier

    out = {}
    for (run,) in train.select(F.explode("runs").alias("run")).distinct().collect():
        own = train.filter(F.array_contains("runs", run)).select("label", array_to_vector("x").alias("features"))
        model = fit_classifier("logreg", own, balanced=balanced).model
        out[run] = Linear(np.r_[model.coefficients.toArray(), model.intercept])
    return out


def _random_forest(train: DataFrame, seed: int, trees: int = 300, depth: int | None = None, **options):
    return fit_forests(train, ForestSpec(trees, depth, seed=seed), **options)


def _gbt(train: DataFrame, seed: int, rounds: int = 300, rate: float = 0.05, depth: int = 6, subsample: float = 1.0, **options):
    return fit_boosters(train, BoostSpec(rounds, rate, depth, subsample=subsample, seed=seed), **options)


def _gbt_calibrated(train: DataFrame, seed: int, rounds: int = 100, rate: float = 0.3, depth: int = 6, folds: int = 3, **options) -> dict[int, Calibrated]:
    """Each class is spread over ``folds`` parts; the boosters of all parts and runs are fitted together, then all curves."""
    split = stage(stratified_kfold(train, "label", folds, seed, "key", "part"), "calibration")
    inner = split.withColumn("runs", F.expr(f"flatten(transform(runs, r -> transform(filter(sequence(0, {folds - 1}), c -> c <> part), c -> r * {folds} + c)))"))
    boosters = _gbt(inner, seed, rounds, rate, depth, **options)
    held = split.select(F.col("key").alias("text_id"), "label", F.expr(f"filter(transform(runs, r -> CAST(r * {folds} + part AS INT)), r -> r IN ({', '.join(map(str, boosters)) or 'NULL'}))").alias("runs"), "x")
    curves = fit_isotonic(scored(held, boosters))
    out: dict[int, Calibrated] = {}
    for run in sorted(curves):
        out.setdefault(run // folds, Calibrated([])).members.append((boosters[run], curves[run]))
    return out


def _mlp(train: DataFrame, seed: int, hidden: Sequence[int] = (1024, 512, 128), dropouts: Sequence[float] | None = None, max_iter: int = 100, task_values: int | None = None, **options):
    """``max_iter`` epochs. Where no ``dropouts`` are given, the first two layers but the last have 0.4 and 0.3."""
    if dropouts is None:
        dropouts = [(0.4, 0.3)[i] if i < min(2, len(hidden) - 1) else 0.0 for i in range(len(hidden))]
    spec = NetworkSpec(tuple(hidden), tuple(dropouts), epochs=max_iter, seed=seed, **options)
    return fit_networks(train, spec, **({} if task_values is None else {"task_values": task_values}))


FITTERS = {"logreg": _logreg, "random_forest": _random_forest, "gbt": _gbt, "gbt_calibrated": _gbt_calibrated, "mlp": _mlp}


def fit_runs(name: str, train: DataFrame, seed: int = 42, **options) -> dict[int, Any]:
    """A model for each run of ``key, label, runs, x`` (see ``inkprobe.fits.table``)."""
    from inkprobe.plans.classifiers import ALIASES, list_classifiers

    fitter = FITTERS.get(ALIASES.get(name, name))
    if fitter is None:
        raise KeyError(f"classifier {name!r} is not known; known: {list_classifiers()}")
    return fitter(train, seed, **options)


def row_key(id_col: str = "text_id") -> Column:
    """What all draws of a fit depend on."""
    return F.xxhash64(F.col(id_col).cast("string"))


def scaler_of(train: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and population deviation of each feature for each run, in one aggregate."""
    values = train.select(F.explode("runs").alias("run"), F.posexplode("x").alias("feature", "value"))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    width: dict[int, int] = {}
    rows = values.groupBy("run", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    for r in rows:
        width[r.run] = max(width.get(r.run, 0), r.feature + 1)
    for run, n in width.items():
        out[run] = (np.zeros(n), np.zeros(n))
    for r in rows:
        out[r.run][0][r.feature], out[r.run][1][r.feature] = r.mean, 0.0 if r.low == r.high else r["std"]
    return out


def scale_rows(rows: DataFrame, scalers: Mapping[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``x`` scaled by the statistics of the row's run; each row has one run."""
    def lists(i: int) -> Column:
        out = F.lit(None).cast("array<double>")
        for run, own in scalers.items():
            out = F.when(F.col("runs")[0] == run, F.array(*[F.lit(float(v)) for v in own[i]])).otherwise(out)
        return out

    centred = F.zip_with("x", lists(0), lambda v, m: v - m)
    return rows.withColumn("x", F.zip_with(centred, lists(1), lambda v, s: F.when(s > 0, v / s).otherwise(F.lit(0.0))))


def save_models(spark: SparkSession, models: Mapping[int, Any], path: str, facts: Mapping[str, Any] | None = None) -> None:
    """Write models, one row each, with ``facts`` about them (columns, metrics); an earlier table there is replaced."""
    said = json.dumps(dict(facts or {}), sort_keys=True)
    rows = [(int(run), type(model).__name__, pickle.dumps(model, 5), said) for run, model in models.items()]
    spark.createDataFrame(rows, "run int, kind string, model binary, facts string").coalesce(1).write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> tuple[dict[int, Any], dict[str, Any]]:
    """Models and facts that ``save_models`` wrote. Models are pickled: load only what you trust."""
    rows = spark.read.parquet(path).collect()
    return {r.run: pickle.loads(bytes(r.model)) for r in rows}, json.loads(rows[0].facts) if rows else {}
