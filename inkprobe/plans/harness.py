"""Three evaluation harnesses: cross-validated, hold-out, and direct."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from inkprobe.fits.grouped import Scaled, fit_runs, row_key, save_models, scale_rows, scaler_of
from inkprobe.fits.table import scored
from inkprobe.operators.evaluation import RATES, evaluate_scores
from inkprobe.operators.reshape import concat_frames
from inkprobe.operators.sampling import stratified_kfold, stratified_split
from inkprobe.plans.classifiers import with_vector
from inkprobe.session import stage

Options = Mapping[str, Mapping[str, object]]
# Models that are written at the same time, and fits that wait for each other's jobs.
SAVERS = 8
FITTERS_AT_ONCE = 4


def at_once(work: Callable[[Any], Any], items: Sequence[Any], most: int = FITTERS_AT_ONCE) -> list[Any]:
    """``work`` for each of ``items`` in order, a few at the same time: small jobs fill each other's gaps."""
    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(work, items))


def _rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``text_id, key, label, x`` for the fits."""
    kinds = dict(df.dtypes)
    if len(columns) == 1 and kinds[columns[0]].startswith("array"):
        x = F.col(columns[0]).cast("array<double>")
    elif any(kinds[c] == "vector" for c in columns):
        df, x = with_vector(df, columns, "_x"), vector_to_array("_x")
    else:
        x = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return df.select("text_id", row_key().alias("key"), F.col("label").cast("int").alias("label"), x.alias("x"))


def cross_validated_scores(
    df: DataFrame, columns: Sequence[str], classifiers: Sequence[str], k: int = 5, seed: int = 42, options: Options | None = None
) -> DataFrame:
    """``classifier, run, text_id, label, score``: every row scored by the model of the k - 1 folds without it (``run``: its fold).

    The folds of a classifier are fitted together, unscaled. A row is stored once and says which folds learn from it.
    """
    folded = stratified_kfold(stage(_rows(df, columns), "vectors"), "label", k, seed)
    folds = F.array(*[F.lit(f) for f in range(k)])
    folded = stage(folded.withColumn("runs", F.filter(folds, lambda f: f != F.col("fold"))), "folds")
    held = folded.withColumn("runs", F.array("fold"))

    def fitted(name: str) -> DataFrame:
        models = fit_runs(name, folded.select("key", "label", "runs", "x"), seed, **(options or {}).get(name, {}))
        return scored(held, models).withColumn("classifier", F.lit(name))

    return concat_frames(at_once(fitted, classifiers)).select("classifier", "run", "text_id", "label", "score")


def cross_validated_eval(
    df: DataFrame, columns: Sequence[str], classifiers: Sequence[str], k: int = 5, seed: int = 42, options: Options | None = None
) -> DataFrame:
    """Mean of the five metrics over k stratified folds, unscaled features.

    ``df`` has ``text_id, label`` and the feature columns. One row per classifier; all
    folds of all classifiers are scored in a single job.
    """
    per_fold = evaluate_scores(cross_validated_scores(df, columns, classifiers, k, seed, options), by=["classifier", "run"])
    return per_fold.groupBy("classifier").agg(*[F.avg(m).alias(m) for m in RATES])


def run_scores(
    rows: DataFrame, classifier: str, seed: int = 42, scale: bool = True, options: Mapping[str, object] | None = None,
    save_to: Mapping[int, str] | None = None, facts: Mapping[int, Mapping[str, object]] | None = None,
) -> DataFrame:
    """``run, text_id, label, score`` of the test rows of ``text_id, key, label, runs, x, is_test``; each row has one run.

    All runs are scaled by their own training rows, in one aggregate, and fitted together. ``save_to`` names a path for each run, where its model, scaler
    included, its ``facts`` and its metrics on the test rows are kept.
    """
    train = rows.filter("NOT is_test")
    scalers = scaler_of(train) if scale else {}
    if scale:
        rows = stage(scale_rows(rows, scalers), "scaled")
        train = rows.filter("NOT is_test")
    models = fit_runs(classifier, train.select("key", "label", "runs", "x"), seed, **(options or {}))
    out = scored(rows.filter("is_test"), models)
    if save_to is not None:
        out = stage(out, "scores")
        rates = {r.run: {m: r[m] for m in RATES} for r in evaluate_scores(out, by=["run"]).collect()}

        def save(run: int) -> None:
            model = Scaled(*scalers[run], models[run]) if scale else models[run]
            save_models(rows.sparkSession, {0: model}, save_to[run], {"classifier": classifier, "metrics": rates.get(run), **(facts or {}).get(run, {})})

        at_once(save, list(save_to), SAVERS)
    return out


def holdout_scores(
    df: DataFrame, columns: Sequence[str], classifiers: Sequence[str], test_size: float = 0.2, seed: int = 42,
    scale: bool = True, options: Options | None = None, save_to: str | None = None,
) -> DataFrame:
    """``classifier, text_id, label, score`` of the held-out rows.

    With ``save_to`` each fitted classifier is saved below it, scaler included, with its metrics on the held-out rows.
    """
    split = stratified_split(stage(_rows(df, columns), "vectors"), "label", test_size, seed)
    split = stage(split.withColumn("runs", F.array(F.lit(0))), "split")

    def fitted(name: str) -> DataFrame:
        path = {0: f"{save_to.rstrip('/')}/{name}"} if save_to else None
        got = run_scores(split, name, seed, scale, (options or {}).get(name, {}), path, {0: {"columns": list(columns)}})
        return got.select(F.lit(name).alias("classifier"), "text_id", "label", "score")

    return concat_frames(at_once(fitted, classifiers))


def holdout_eval(
    df: DataFrame, columns: Sequence[str], classifiers: Sequence[str], test_size: float = 0.2, seed: int = 42,
    scale: bool = True, options: Options | None = None,
) -> DataFrame:
    """Fit on 80 per cent (scaled by their statistics), evaluate on the rest at 0.5."""
    scores = holdout_scores(df, columns, classifiers, test_size, seed, scale, options)
    return evaluate_scores(scores, by=["classifier"])


def direct_score_eval(df: DataFrame, score_col: str = "score", threshold: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """No fit, no split: every row's own signed score against its label."""
    return evaluate_scores(df, score_col, threshold=threshold, by=by)
