"""Report tables over result rows and performance rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inkprobe.functions.text import round4

# Paradigm of each known model.
PARADIGMS = {
    "gpt2": "Autoregressive",
    "gpt3_proxy": "Autoregressive",
    "llama2_7b": "Autoregressive",
    "llama3_1_8b": "Autoregressive",
    "bert": "Masked LM",
    "roberta": "Masked LM",
    "modernbert": "Masked LM",
    "llada_8b_base": "Diffusion",
    "llada_8b_vrpo": "Diffusion",
    "dream_llada_7b": "Diffusion",
    # The count models of this package.
    "count_causal": "Autoregressive",
    "count_masked": "Masked LM",
    "count_diffusion": "Diffusion",
}

# Dataset order of the tables, and the two model groups compared.
MAIN_DATASETS = ["mage", "raid", "deepfaketextdetect", "beemo", "m4gt_bench"]
SMALL_MODELS = ["bert", "roberta", "modernbert"]
LARGE_MODELS = ["llama2_7b", "llama3_1_8b", "llada_8b_base", "llada_8b_vrpo", "dream_llada_7b"]


def paradigm_of(model: Column, paradigms: Mapping[str, str] = PARADIGMS) -> Column:
    """Paradigm of a model name; null for an unknown one."""
    entries = [F.lit(x) for pair in paradigms.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), model)


def lookup_paradigm(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Left join to a ``model, paradigm`` registry table; the planner sizes the join."""
    return df.join(registry.select("model", "paradigm"), "model", "left")


def filter_models(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Rows of the named models."""
    return df.filter(F.col("model").isin(list(models)))


def filter_uncached(df: DataFrame) -> DataFrame:
    """Rows that were computed, not read from the feature cache."""
    return df.filter(~F.col("cached"))


def sort_results(df: DataFrame, keys: Sequence[str] = ("paradigm", "model", "strategy")) -> DataFrame:
    """Ascending by all keys, nulls last."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def sort_desc_top1(df: DataFrame, col: str, *ties: str) -> DataFrame:
    """The row with the largest value; NaN and null never win. ``ties`` break equal values."""
    valued = df.filter(F.col(col).isNotNull() & ~F.isnan(col))
    return valued.orderBy(F.desc(col), *ties).limit(1)


def best_classifier(df: DataFrame, by: Sequence[str], order: Sequence[str] = ("classifier",)) -> DataFrame:
    """Row with the largest ROC-AUC per group; NaN skipped, first in ``order`` on ties.

    An aggregate, not a window: groups are reduced map-side, so a huge group costs
    nothing extra.
    """
    rest = [c for c in df.columns if c not in by]
    rank = F.struct(F.col("roc_auc"), *[_descending(df, c) for c in order])
    valued = df.filter(F.col("roc_auc").isNotNull() & ~F.isnan("roc_auc"))
    top = valued.groupBy(*by).agg(F.max_by(F.struct(*rest), rank).alias("top"))
    return top.select(*by, *[F.col(f"top.{c}").alias(c) for c in rest])


def _descending(df: DataFrame, name: str) -> Column:
    """Value whose ascending order is the descending order of a column."""
    if df.schema[name].dataType.simpleString() == "string":
        # Complement of the UTF-8 bytes, closed by a byte above all of them.
        raw = F.hex(F.encode(F.col(name), "UTF-8"))
        return F.concat(F.translate(raw, "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return -F.col(name)


def best_classifier_per_strategy(
    df: DataFrame,
    by: Sequence[str] = ("model", "strategy"),
    order: Sequence[str] = ("classifier",),
    paradigms: Mapping[str, str] = PARADIGMS,
) -> DataFrame:
    """Best classifier of each (model, strategy) with its paradigm, sorted."""
    best = best_classifier(df, by, order).withColumn("paradigm", paradigm_of(F.col("model"), paradigms))
    lead = [c for c in by if c not in ("model", "strategy")]
    columns = [*lead, "paradigm", "model", "strategy", "classifier", "roc_auc", "accuracy", "f1"]
    return sort_results(best.select(*columns), [*lead, "paradigm", "model", "strategy"])


def main_tables(
    df: DataFrame,
    datasets: Sequence[str] = MAIN_DATASETS,
    order: Sequence[str] = ("classifier",),
    paradigms: Mapping[str, str] = PARADIGMS,
) -> DataFrame:
    """The per-dataset tables of all main datasets in one job; absent datasets are absent."""
    main = df.filter(F.col("dataset").isin(list(datasets)))
    return best_classifier_per_strategy(main, ("dataset", "model", "strategy"), order, paradigms)


def best_model(df: DataFrame) -> DataFrame:
    """Model with the largest ROC-AUC overall; the first by name on ties."""
    valued = df.filter(F.col("roc_auc").isNotNull() & ~F.isnan("roc_auc"))
    key = F.struct(F.col("roc_auc"), _descending(df, "model"))
    return valued.agg(F.max_by("model", key).alias("model"), F.max("roc_auc").alias("roc_auc"))


def pivot_best(df: DataFrame, models: Sequence[str] | None = None, datasets: Sequence[str] = MAIN_DATASETS) -> DataFrame:
    """(model, strategy) rows by dataset columns: best ROC-AUC with four decimals.

    The column list is fixed, so the pivot is a single aggregate; a dataset without any
    value loses its column.
    """
    chosen = df if models is None else filter_models(df, models)
    valued = chosen.filter(F.col("roc_auc").isNotNull() & ~F.isnan("roc_auc"))
    present = {r[0] for r in valued.filter(F.col("dataset").isin(list(datasets))).select("dataset").distinct().collect()}
    names = [d for d in datasets if d in present]
    table = valued.groupBy("model", "strategy").pivot("dataset", names).agg(F.max("roc_auc"))
    return table.select("model", "strategy", *[round4(F.col(n)).alias(n) for n in names]).orderBy("model", "strategy")


def family_table(df: DataFrame, datasets: Sequence[str] = MAIN_DATASETS) -> DataFrame:
    """Comparison over all models of one run."""
    return pivot_best(df, None, datasets)


def small_model_table(df: DataFrame, models: Sequence[str] = SMALL_MODELS, datasets: Sequence[str] = MAIN_DATASETS) -> DataFrame:
    """Comparison of the small models."""
    return pivot_best(df, models, datasets)


def large_model_table(df: DataFrame, models: Sequence[str] = LARGE_MODELS, datasets: Sequence[str] = MAIN_DATASETS) -> DataFrame:
    """Comparison of the large models."""
    return pivot_best(df, models, datasets)


def performance_table(performance: DataFrame) -> DataFrame:
    """Computed (not cached) performance rows."""
    return filter_uncached(performance)


def comparison_by_score(
    df: DataFrame, score_col: str, classifiers: Mapping[str, str], sort_by: str, metrics: Sequence[str] = ("roc_auc", "accuracy", "f1", "precision", "recall")
) -> DataFrame:
    """One wide row per score column, ``<classifier>_<metric>`` columns, best first.

    ``classifiers`` maps classifier names to column prefixes.
    """
    cells = [
        F.max(F.when(F.col("classifier") == name, F.col(m))).alias(f"{prefix}_{m}")
        for name, prefix in classifiers.items()
        for m in metrics
    ]
    return df.groupBy(score_col).agg(*cells).orderBy(F.desc_nulls_last(sort_by), F.col(score_col))
