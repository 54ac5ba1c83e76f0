import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprobe import session
from inkprobe.operators.scaling import standard_scale
from inkprobe.plans import backbones as bb, classifiers as cl, experiment as ex, harness as hs
from inkprobe.plans.strategies import evaluate_strategy
from inkprobe.sources import corpora
from inkprobe.sources.features import FeatureKey, feature_cache


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = (x[:, 0] + 0.3 * rng.normal(size=60) > 0.4).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "text_id bigint, label int, " + ", ".join(f"x{j} double" for j in range(5)))
    return df.cache(), x, y


def test_population_scaling(spark, toy):
    df, x, _ = toy
    flat = df.withColumn("flat", F.lit(0.1))
    rows = standard_scale(flat, flat, ["x0", "flat"]).orderBy("text_id").collect()
    assert [r.x0 for r in rows] == pytest.approx(list((x[:, 0] - x[:, 0].mean()) / x[:, 0].std()))
    assert {r.flat for r in rows} == {0.0}
    vectors = cl.with_vector(df, ["x0", "x1"])
    from pyspark.ml import Pipeline

    scaled = Pipeline(stages=cl.population_scaler(60, 2)).fit(vectors).transform(vectors).orderBy("text_id").collect()
    expected = (x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0)
    assert np.allclose([r.scaled.toArray() for r in scaled], expected)


def test_logreg_reaches_the_balanced_l2_optimum(spark, toy):
    df, x, y = toy
    fitted = cl.fit_classifier("logreg", cl.with_vector(df, [f"x{j}" for j in range(5)])).model
    # Newton on 0.5 |w|^2 + sum of weighted losses (C = 1, intercept free).
    weight = np.where(y == 1, 60 / (2 * y.sum()), 60 / (2 * (60 - y.sum())))
    a, w = np.hstack([x, np.ones((60, 1))]), np.zeros(6)
    penalty = np.diag([1.0] * 5 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        gradient = a.T @ (weight * (p - y)) + penalty @ w
        w -= np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + penalty, gradient)
    assert np.allclose([*fitted.coefficients.toArray(), fitted.intercept], w, atol=1e-4)


@pytest.mark.parametrize(
    "name, options",
    [
        ("deep_mlp", {"hidden": (8, 4), "max_iter": 10}),
        ("random_forest", {"trees": 5, "depth": 4}),
        ("xgboost", {"rounds": 2, "depth": 2}),
        ("xgboost_calibrated", {"rounds": 2, "depth": 2}),
    ],
)
def test_classifiers_give_probabilities(spark, toy, name, options):
    df = cl.with_vector(toy[0], [f"x{j}" for j in range(5)])
    rows = cl.fit_classifier(name, df, seed=1, **options).predict(df).collect()
    assert len(rows) == 60 and all(0.0 <= r.score <= 1.0 for r in rows)


def test_unknown_names_are_refused(spark, toy):
    with pytest.raises(KeyError):
        cl.fit_classifier("svm", toy[0])
    with pytest.raises(KeyError):
        bb.apply_backbone(spark.createDataFrame([(1, "x")], "text_id int, text string"), "nobody", "score")


def test_holdout_and_cross_validation(spark, toy):
    columns = [f"x{j}" for j in range(5)]
    holdout = hs.holdout_eval(toy[0], columns, ["logreg"]).first()
    crossed = hs.cross_validated_eval(toy[0], columns, ["logreg"], k=3).first()
    assert holdout.roc_auc > 0.8 and crossed.roc_auc > 0.8


def make_model():
    def build():
        class Model:
            def zero_shot_score(self, texts):
                return [1.0 if "good" in t else -1.0 for t in texts]

            def score(self, texts):
                return [float(len(t)) for t in texts]

        return Model()

    return build


def test_plugged_model_zero_shot(spark):
    bb.register_backbone("probe", make_model())
    texts = spark.createDataFrame(
        [(i, "good" if i < 5 else "bad", int(i < 5)) for i in range(10)], "text_id bigint, text string, label int"
    ).repartition(3)
    rows = evaluate_strategy("zero_shot", bb.PluggedModel("probe").zero_shot_score(texts), texts, ["prompt", "twin"]).collect()
    assert [r.classifier for r in rows] == ["prompt", "twin"]
    assert all(r.roc_auc == r.accuracy == r.f1 == 1.0 for r in rows)


def test_feature_keys_and_cache(spark, tmp_path):
    base = FeatureKey("mage", "bert", "score", 40, 1)
    others = [
        FeatureKey("mage", "bert", "score", 10_000, 1),
        FeatureKey("mage", "bert", "score", 40, 2),
        FeatureKey("mage", "bert", "embedding", 40, 1),
        FeatureKey("mage", "bert", "score", 40, 1, {"max_length": 512}),
    ]
    assert len({k.path("/r") for k in [base, *others]}) == 5
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    _, _, first = feature_cache(spark, str(tmp_path), base, build)
    df, seconds, second = feature_cache(spark, str(tmp_path), base, build)
    assert (first, second, seconds, len(calls), df.count()) == (False, True, 0.0, 1, 3)


def test_run_experiment_writes_and_caches(spark, tmp_path):
    bb.register_backbone("probe", make_model())
    rows = spark.createDataFrame([(i, "good" if i % 2 else "bad", i % 2) for i in range(40)], "id bigint, text string, label int")
    spec = ex.Experiment(
        datasets={"toy": lambda n, seed: corpora.from_plain(rows, F.col("id"), n, seed)},
        models={"probe": ex.configured(lambda sample: bb.PluggedModel("probe"), {"kind": "probe"})},
        strategies={"zero_shot": ["prompt"]},
        n_total=20,
    )
    for cached in (False, True):
        results, timing = ex.run_experiment(spark, spec, str(tmp_path / "cache"), str(tmp_path / "out"))
        assert [(r.dataset, r.model, r.strategy, r.classifier, r.roc_auc) for r in results.collect()] == [
            ("toy", "probe", "zero_shot", "prompt", 1.0)
        ]
        assert timing.first().cached is cached
    from inkprobe.sources.results import read_results, unified_performance

    assert read_results(spark, str(tmp_path / "out.csv")).count() == 1
    assert unified_performance(spark, str(tmp_path)).first().source_file == "out_performance.csv"


def test_cache_depends_on_every_setting(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} w{i % 5}", i % 2) for i in range(40)], "text_id long, text string, label int")
    cached = []
    for alpha, sample in ((0.1, rows), (0.1, rows), (50.0, rows), (0.1, rows.filter("text_id < 30"))):
        spec = ex.Experiment(
            {"d": lambda n, seed, s=sample: s}, {"count": ex.count_builder(bb.CountSpec(alpha=alpha))}, {"score": ["logreg"]}, n_total=40
        )
        _, timing = ex.run_experiment(spark, spec, str(tmp_path))
        cached.append(timing.first()["cached"])
    assert cached == [False, True, False, False]


def test_experiments_are_refused_before_any_work(spark, tmp_path):
    never = lambda n, seed: pytest.fail("loaded")
    for build, strategy in ((ex.count_builder(bb.CountSpec()), "zero_shot"), (lambda sample: None, "score")):
        with pytest.raises(ValueError):
            ex.run_experiment(spark, ex.Experiment({"d": never}, {"m": build}, {strategy: ["logreg"]}, n_total=2), str(tmp_path))


def test_embed_keeps_all_texts_where_vector_ids_have_gaps(spark):
    rows = spark.createDataFrame([(i, f"a b{i}") for i in range(6)], "text_id long, text string")
    vectors = spark.createDataFrame([(10, [1.0, 2.0]), (700, [3.0, 4.0]), (9, [5.0, 6.0])], "vec_id long, vec array<double>")
    model = bb.CountModel.fit(bb.CountSpec(), rows)
    assert model.embed(rows, vectors).count() == 6


def test_models_get_bounded_parts_and_workers_one_model(spark, tmp_path):
    import sys

    def build(out=str(tmp_path)):
        class Model:
            def score(self, texts):
                import os

                with open(f"{out}/{os.getpid()}", "a") as log:
                    log.write(f"{len(texts)} {sum(len(t or '') for t in texts)} {len(sys.__dict__['_inkprobe_models'])}\n")
                return [float(len(t or "")) for t in texts]

        return Model()

    rows = [(i, "x" * (10_000_000 if i % 10 == 0 else 1000 * i)) for i in range(30)] + [(99, None)] + [(100 + i, "s") for i in range(3000)]
    texts = spark.createDataFrame(rows, "text_id long, text string").coalesce(2)
    bb.register_backbone("first", build)
    bb.apply_backbone(texts.limit(1), "first", "score").count()
    bb.register_backbone("second", build)
    got = {r.text_id: r.score for r in bb.apply_backbone(texts, "second", "score").collect()}
    assert got == {i: float(len(t or "")) for i, t in rows}
    calls = [tuple(map(int, line.split())) for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    assert all((n == 1 or size <= bb.MODEL_BYTES) and n <= bb.MODEL_ROWS and models == 1 for n, size, models in calls)


def test_regressions_predict_in_a_session_that_has_observed(spark):
    """An observation stays with the session; a model that holds the session could not be sent to the tasks."""
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    rows = spark.createDataFrame([(i, i % 2, float(i % 2) + 0.1 * (i % 3)) for i in range(40)], "text_id int, label int, a double")
    chain = cl.fit_chain(rows, ["a"])
    assert {r.label == r.prediction for r in chain.transform(rows).collect()} == {True}
    vectors = cl.with_vector(rows, ["a"])
    scores = cl.fit_classifier("logreg", vectors).predict(vectors).collect()
    assert {(r.score > 0.5) == r.label for r in scores} == {True}


def test_models_of_the_experiment_run_together(spark, monkeypatch):
    """Both models begin before one ends, and in each the strategies with a network begin first; results keep their order."""
    from threading import Barrier

    from inkprobe import catalog
    from inkprobe.catalog import learning

    both, begun = Barrier(2), []

    def fake(spark, spec, cache, output):
        both.wait(30)
        return spark.createDataFrame([(m,) for m in spec.models], "model string"), None

    monkeypatch.setattr(learning.ex, "run_experiment", fake)
    assert [r.model for r in catalog.QUERIES["run_experiment"](spark, "/root/testdata/sf0.001").collect()] == ["count_causal", "toy"]
    monkeypatch.undo()
    sample = spark.createDataFrame([(i, "a " * (i % 5 + 1), i % 2) for i in range(40)], "text_id long, text string, label int")
    bb.register_backbone("plain", learning.toy_factory())
    monkeypatch.setattr(ex, "evaluate_strategy", lambda name, *a: begun.append(name) or spark.createDataFrame([(name, 1.0)], "strategy string, roc_auc double"))
    monkeypatch.setattr(ex, "at_once", lambda work, items: [work(i) for i in items])
    build = ex.configured(lambda s: bb.PluggedModel("plain"), {"kind": "plain"})
    spec = ex.Experiment({"d": lambda n, seed: sample}, {"plain": build}, {"score": ["logreg"], "pawn": ["logreg", "deep_mlp"]}, 40)
    rows = ex.run_experiment(spark, spec, str(session.staging_path(spark, "cache")))[0].collect()
    assert begun == ["pawn", "score"] and [r.strategy for r in rows] == ["score", "pawn"]
