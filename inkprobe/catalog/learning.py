"""Classifiers, harnesses, strategies, experiments, plug-in models.

Fits have no SQL counterpart; what SQL can state about them is checked in ``tests/``.
Classifiers have the sizes of their operators.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from inkprobe.catalog.evaluation import auc_sql, rate_sql
from inkprobe.catalog.registry import (
    TURNS_SQL, largest_balanced, query, quality_rows, rounded, sample_sql, scratch, table, turn_rows,
)
from inkprobe.catalog.tokens import (
    P_END, P_MASK, P_START, _CAUSAL, _PREFIX, _SUFFIX, _prompt_sql, text_ids, texts,
)
from inkprobe.operators.averages import METRICS
from inkprobe.operators.reshape import concat_frames
from inkprobe.plans import backbones as bb, classifiers as cl, experiment as ex, harness as hs
from inkprobe.plans.strategies import evaluate_strategy
from inkprobe.session import stage
from inkprobe.sources import corpora
from inkprobe.sources.features import FeatureKey, feature_cache

# Classifiers of each strategy, as in the reference's experiment files.
CLASSIFIERS = {
    "score": ["logreg", "random_forest", "gbt", "gbt_calibrated"],
    "pawn": ["logreg", "mlp"],
    "embedding": ["logreg"],
    "zero_shot": ["prompt"],
}


def vector_rows(spark, sf_dir):
    """``text_id, label, embedding``: classes 0-4 against 5-9, all vectors."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("text_id"), (F.col("label") >= 5).cast("int").alias("label"), "embedding"
    )


def _columns(spark, sf_dir) -> tuple:
    """``text_id, label`` and a column for each place of the vectors; the names of these."""
    rows = vector_rows(spark, sf_dir)
    names = [f"x{i}" for i in range(rows.agg(F.max(F.size("embedding"))).first()[0])]
    return rows.select("text_id", "label", *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(names)]), names


def _holdout(name: str):
    def run(spark, sf_dir):
        rows = hs.holdout_eval(vector_rows(spark, sf_dir), ["embedding"], [name])
        return rounded(rows)

    run.__doc__ = f"Hold-out of {name} on the vectors."
    return run


for _name in ("logreg", "random_forest", "gbt", "gbt_calibrated", "mlp"):
    query(f"classifier_{_name}")(_holdout(_name))


@query("holdout_eval")
def holdout_eval(spark, sf_dir):
    return rounded(hs.holdout_eval(vector_rows(spark, sf_dir), ["embedding"], ["logreg", "mlp"]))


@query("cross_validated_eval")
def cross_validated_eval(spark, sf_dir):
    return rounded(hs.cross_validated_eval(vector_rows(spark, sf_dir), ["embedding"], ["logreg"]))


def _sample(spark, sf_dir):
    rows = turn_rows(spark, sf_dir)
    return corpora.from_source(rows, F.col("id"), n_total=largest_balanced(rows))


def _count_model(sample, paradigm: str = "causal"):
    return bb.CountModel.cross_fit(bb.CountSpec(paradigm), sample)


@query("strategy_score")
def strategy_score(spark, sf_dir):
    sample = stage(_sample(spark, sf_dir), "sample")
    features = stage(_count_model(sample).score(sample), "features")
    return rounded(evaluate_strategy("score", features, sample, CLASSIFIERS["score"]))


@query("strategy_pawn")
def strategy_pawn(spark, sf_dir):
    sample = stage(_sample(spark, sf_dir), "sample")
    features = stage(_count_model(sample, "masked").pawn_metrics(sample), "features")
    return rounded(evaluate_strategy("pawn", features, sample, CLASSIFIERS["pawn"]))


@query("strategy_embedding")
def strategy_embedding(spark, sf_dir):
    sample = stage(_sample(spark, sf_dir), "sample")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    features = stage(_count_model(sample, "diffusion").embed(sample, vectors), "features")
    return rounded(evaluate_strategy("embedding", features, sample, CLASSIFIERS["embedding"]))


def toy_factory():
    """Factory of a tiny deterministic model; nested, so that workers need no package."""

    def build():
        class Toy:
            def score(self, texts):
                return [-len(t.split(" ")) / 100.0 for t in texts]

            def pawn_metrics(self, texts):
                size = [float(len(t.split(" "))) for t in texts]
                names = ["Mlog_prob", "Mentropy", "Mmax_log_prob", "Mrank", "Mtop_p"]
                return {m: [n * (i + 1) for n in size] for i, m in enumerate(names)}

            def embed(self, texts):
                return [[float(len(t)), float(len(t.split(" ")))] for t in texts]

            def zero_shot_score(self, texts):
                return [150.0 - len(t) for t in texts]

            def answer_logits(self, ids, positions):
                return [[sum(i) % 11, len(i) % 5, i[p] % 3, 1.0] for i, p in zip(ids, positions)]

        return Toy()

    return build


_FLAT = "string_split(text, ' ')"


@query("apply_backbone_score", "SELECT doc_id AS text_id, round(-len(string_split(text, ' ')) / 100.0, 6)::DOUBLE AS score FROM documents")
def apply_backbone_score(spark, sf_dir):
    """A plugged-in model runs over all documents, Arrow batch by batch."""
    bb.register_backbone("toy", toy_factory())
    return rounded(bb.PluggedModel("toy").score(texts(spark, sf_dir)))


@query(
    "apply_backbone_pawn_metrics",
    "SELECT text_id, "
    + ", ".join(f'(n * {i + 1})::DOUBLE AS "{m}"' for i, m in enumerate(METRICS))
    + " FROM (SELECT doc_id AS text_id, len(string_split(text, ' ')) AS n FROM documents)",
)
def apply_backbone_pawn_metrics(spark, sf_dir):
    bb.register_backbone("toy", toy_factory())
    return bb.PluggedModel("toy").pawn_metrics(texts(spark, sf_dir))


@query(
    "apply_backbone_embed",
    """SELECT doc_id AS text_id, length(text)::DOUBLE AS chars, len(string_split(text, ' '))::DOUBLE AS words FROM documents""",
)
def apply_backbone_embed(spark, sf_dir):
    bb.register_backbone("toy", toy_factory())
    rows = bb.PluggedModel("toy").embed(texts(spark, sf_dir))
    at = lambda i: F.element_at("embedding", i).cast("double")
    return rows.select("text_id", at(1).alias("chars"), at(2).alias("words"))


_TOY_SQL = " SELECT text_id, ((list_sum(ids) % 11 + 11) % 11 - len(ids) % 5)::DOUBLE AS zero_shot_score FROM prompt"


@query("causal_zero_shot_score", _prompt_sql([*_CAUSAL, P_END], 512 - len(_CAUSAL) - 2) + _TOY_SQL)
def causal_zero_shot_score(spark, sf_dir):
    """Prompt of every document, model answer, log odds."""
    bb.register_backbone("toy", toy_factory())
    return bb.causal_zero_shot_score(text_ids(spark, sf_dir, 512), "toy", _CAUSAL, 0, 1, 512, [P_START], [P_END])


@query(
    "cloze_zero_shot_score",
    _prompt_sql([*_PREFIX, P_MASK, *_SUFFIX, P_END], 512 - len(_PREFIX) - 1 - len(_SUFFIX) - 2) + _TOY_SQL.replace("len(ids) % 5", f"{P_MASK % 3}"),
)
def cloze_zero_shot_score(spark, sf_dir):
    """Read at the masked slot: the toy answers with the id it finds there."""
    bb.register_backbone("toy", toy_factory())
    return bb.cloze_zero_shot_score(text_ids(spark, sf_dir, 512), "toy", _PREFIX, P_MASK, _SUFFIX, 0, 2, 512, [P_START], [P_END])


_ZERO_SHOT_SQL = f"""WITH {TURNS_SQL}, {sample_sql('turns', None)},
toy AS (SELECT 'zero_shot' AS run, label, 150.0 - length(text) AS score, CASE WHEN length(text) <= 150 THEN 1 ELSE 0 END AS pred FROM sample),
cells AS (SELECT run, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label <> 1 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred <> 1) AS fn, count(*) FILTER (label <> 1 AND pred <> 1) AS tn FROM toy GROUP BY run),
{auc_sql('toy', 'run')}
SELECT run AS strategy, classifier, round(roc_auc, 6) AS roc_auc, {', '.join(rate_sql(n) for n in ('accuracy', 'f1', 'recall', 'precision'))}
FROM cells JOIN areas USING (run), (VALUES ('prompt'), ('again')) AS v(classifier)"""


@query("strategy_zero_shot", _ZERO_SHOT_SQL)
def strategy_zero_shot(spark, sf_dir):
    """Each listed name gets the same row; every turn of the sample is used."""
    bb.register_backbone("toy", toy_factory())
    sample = stage(_sample(spark, sf_dir), "sample")
    features = bb.PluggedModel("toy").zero_shot_score(sample)
    return rounded(evaluate_strategy("zero_shot", features, sample, ["prompt", "again"]))


@query("feature_cache", "SELECT doc_id AS text_id, length(text)::BIGINT AS size, cached FROM documents, (VALUES (FALSE), (TRUE)) AS v(cached)")
def feature_cache_twice(spark, sf_dir):
    """Computed at the first call, read at the second, with equal rows."""
    root = scratch(spark, "cache")
    key = FeatureKey("documents", "size", "score", 0, 41, {"unit": "chars"})
    rows = texts(spark, sf_dir).select("text_id", F.length("text").cast("bigint").alias("size"))
    (first, _, fresh), (second, seconds, hit) = (feature_cache(spark, root, key, lambda: rows) for _ in range(2))
    assert not fresh and hit and seconds == 0.0
    return first.withColumn("cached", F.lit(False)).unionByName(second.withColumn("cached", F.lit(True)))


@query("save_load_model", "SELECT vec_id AS text_id, TRUE AS same FROM embeddings")
def save_load_model(spark, sf_dir):
    """A saved chain of scaler and regression predicts the same after loading."""
    rows, names = _columns(spark, sf_dir)
    path = scratch(spark, "model")
    fitted = cl.fit_chain(rows, names)
    cl.save_model(fitted, path)
    one = fitted.transform(rows).select("text_id", vector_to_array("probability").alias("p"))
    two = cl.load_model(path).transform(rows).select("text_id", vector_to_array("probability").alias("q"))
    return one.join(two, "text_id").select("text_id", (F.col("p") == F.col("q")).alias("same"))


@query("run_experiment")
def run_experiment(spark, sf_dir):
    """Two whole corpora by two models by all strategies that the model can serve, with cached features and result files."""
    bb.register_backbone("toy", toy_factory())
    classes = quality_rows(spark, sf_dir).withColumn("source", F.col("label"))
    largest = {"turns": largest_balanced(turn_rows(spark, sf_dir)), "quality": largest_balanced(classes)}
    datasets = {
        "turns": lambda n, seed: corpora.from_source(turn_rows(spark, sf_dir), F.col("id"), min(n, largest["turns"]), seed),
        "quality": lambda n, seed: corpora.from_plain(quality_rows(spark, sf_dir), F.col("id"), min(n, largest["quality"]), seed),
    }
    models = {
        "count_causal": ex.count_builder(bb.CountSpec("causal")),
        "toy": ex.configured(lambda sample: bb.PluggedModel("toy"), {"kind": "toy"}),
    }
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    def experiment(name: str):
        build = models[name]
        strategies = {s: c for s, c in CLASSIFIERS.items() if s in getattr(build, "methods", CLASSIFIERS)}
        spec = ex.Experiment(datasets, {name: build}, strategies, max(largest.values()), vectors=vectors)
        return ex.run_experiment(spark, spec, scratch(spark, "cache"), scratch(spark, "results"))[0]

    # At the same time, as the networks of a model take a core each for long.
    results = hs.at_once(experiment, list(models))
    return rounded(concat_frames(results))


@query("tune_masking")
def tune_masking(spark, sf_dir):
    """All settings of the masking draws, featurised in one job."""
    sample = stage(_sample(spark, sf_dir), "sample")
    model = _count_model(sample, "diffusion")
    return rounded(ex.tune_masking(model, sample))


@query("mlp_by_score")
def mlp_by_score(spark, sf_dir):
    """The network on single columns."""
    rows, names = _columns(spark, sf_dir)
    ranked = ex.mlp_by_score(rows, names, scratch(spark, "networks"))
    return rounded(ranked.withColumn("model_path", F.regexp_extract("model_path", "[^/]*$", 0)))
