import inspect
import pickle
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprobe.fits import boosting, forests, isotonic, networks, trees
from inkprobe.fits.binning import feature_cuts
from inkprobe.fits.grouped import fit_runs, load_models, row_key, save_models, scale_rows, scaler_of
from inkprobe.fits.newton import fit_logreg
from inkprobe.fits.table import scored
from inkprobe.fits.trees import Grower, Tree, best_gain, binned, child_path, drawn, gini_split, histograms
from inkprobe.plans import classifiers as cl, experiment as ex, harness as hs


def data(n=240, width=4, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=n) > 0.2).astype(int)
    return x, y


def table(spark, x, y, runs=((0,),)):
    """Row i belongs to the runs of its fold, as in cross-validation."""
    rows = [(i, int(y[i]), list(runs[i % len(runs)]), [float(v) for v in x[i]]) for i in range(len(y))]
    df = spark.createDataFrame(rows, "text_id long, label int, runs array<int>, x array<double>")
    return df.select("text_id", row_key().alias("key"), "label", "runs", "x").repartition(3).cache()


FOLDS = ((1, 2), (0, 2), (0, 1))


def newton(x, y, weight):
    a, w, penalty = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + penalty, a.T @ (weight * (p - y)) + penalty @ w)
    return w


def test_all_folds_reach_their_optimum_in_few_jobs(spark):
    x, y = data()
    train = table(spark, x, y, FOLDS)
    models = fit_logreg(train, 4)
    for fold in range(3):
        own = np.arange(len(y)) % 3 != fold
        n = own.sum()
        weight = np.where(y[own] == 1, n / (2 * y[own].sum()), n / (2 * (n - y[own].sum())))
        assert np.allclose(models[fold].weights, newton(x[own], y[own], weight), atol=1e-7)


def test_regression_from_separable_and_one_class_rows(spark):
    x = np.r_[np.full((20, 1), -50.0), np.full((20, 1), 80.0)]
    models = fit_logreg(table(spark, x, np.repeat([0, 1], 20)), 1)
    assert np.isfinite(models[0].weights).all() and models[0].scores(x)[0] < 0.1 < 0.9 < models[0].scores(x)[-1]
    with pytest.warns(UserWarning):
        alone = fit_logreg(table(spark, x, np.ones(40, int)), 1, most=30)
    assert alone[0].scores(x).min() > 0.9


def brute_split(x, g, h, penalty, least, cuts):
    best = (-np.inf, None)
    for f in range(x.shape[1]):
        for c in cuts[f]:
            left = x[:, f] <= c
            sums = [(g[s].sum(), h[s].sum()) for s in (left, ~left)]
            if min(s[1] for s in sums) < least:
                continue
            gain = sum(a * a / (b + penalty) for a, b in sums) - g.sum() ** 2 / (h.sum() + penalty)
            if gain > best[0] + 1e-9:
                best = (gain, (f, c))
    return best


def test_first_tree_equals_brute_force(spark):
    x, y = data()
    spec = boosting.BoostSpec(rounds=1, rate=0.3, depth=2)
    model = boosting.fit_boosters(table(spark, x, y), spec)[0]
    tree, cuts = model.trees[0], model.cuts
    g, h = 0.5 - y, np.full(len(y), 0.25)
    nodes = [(0, np.ones(len(y), bool))]
    for level in range(3):
        following = []
        for node, rows in nodes:
            if tree.feature[node] < 0:
                assert tree.value[node] == pytest.approx(-0.3 * g[rows].sum() / (h[rows].sum() + 1))
                continue
            _, split = brute_split(x[rows], g[rows], h[rows], 1, 1, cuts)
            assert split == (tree.feature[node], cuts[tree.feature[node]][tree.cut[node]])
            right = x[:, split[0]] > split[1]
            following += [(tree.left[node], rows & ~right), (tree.left[node] + 1, rows & right)]
        nodes = following


def test_boosters_are_the_same_in_tasks_and_by_levels(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP_ROUNDS", 2)
    x, y = data(150)
    train = table(spark, x, y, FOLDS)
    spec = boosting.BoostSpec(rounds=4, rate=0.3, depth=3, subsample=0.8)
    one, two = boosting.fit_boosters(train, spec), boosting.fit_boosters(train, spec, task_values=0)
    for run in range(3):
        for a, b in zip(one[run].trees, two[run].trees):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.left == b.left).all()
        assert np.allclose(one[run].scores(x), two[run].scores(x), atol=1e-9)
    assert ((one[0].scores(x) >= 0.5) == y).mean() > 0.75


def test_a_round_adds_up_the_smaller_children_only(monkeypatch):
    """Below the root, at most half of the rows go into histograms, and the others' sums are right."""
    added = []
    monkeypatch.setattr(boosting, "histograms", lambda bins, *a: added.append(len(bins)) or histograms(bins, *a))
    x, y = data(400)
    bins, spec = binned(x, [np.unique(x[:, f])[:-1][:255] for f in range(4)]), boosting.BoostSpec(rounds=2, rate=0.3, depth=4, subsample=0.7)
    grown = boosting.boost_rows(bins, y, np.arange(400), spec)
    assert len(added) == 2 * 4 and max(n for i, n in enumerate(added) if i % 4) <= 200
    z = np.zeros(400)
    for round_, tree in enumerate(grown):
        p, use = 1 / (1 + np.exp(-z)), boosting._taken(np.arange(400), round_, spec)
        g, h, leaf = (p - y) * use, p * (1 - p) * use, tree.leaves(bins)
        for node in np.unique(leaf):
            assert tree.value[node] == pytest.approx(-0.3 * g[leaf == node].sum() / (h[leaf == node].sum() + 1))
        z += tree.value[leaf]


def test_forest_grows_beyond_depth_30_and_alike_everywhere(spark):
    n = 45  # each value is a class of its own side: the classes alternate, so only single values split off
    x = np.arange(n, dtype=float)[:, None].repeat(3, 0)
    y = (np.arange(n) % 2).repeat(3)
    x = np.hstack([x, np.zeros_like(x)])
    train = table(spark, x, y)
    spec = forests.ForestSpec(trees=3, tries=2)
    one, two = forests.fit_forests(train, spec), forests.fit_forests(train, spec, task_values=100)
    assert np.allclose(one[0].scores(x), two[0].scores(x))
    chain_x = np.cumsum(1.0 / np.arange(1, 200))[:, None]
    chain_y = np.r_[[i % 2 for i in range(199)]]
    weight = np.repeat(chain_x, [max(1, 200 - i) for i in range(199)], 0)
    labels = np.repeat(chain_y, [max(1, 200 - i) for i in range(199)])
    deep = forests.fit_forests(table(spark, weight, labels), forests.ForestSpec(trees=2))[0]
    assert max(t.depth() for t in deep.trees) > 30
    assert forests.fit_forests(train, forests.ForestSpec(trees=2, depth=3), task_values=100)[0].trees[0].depth() <= 3


def test_forest_folds_and_accuracy(spark):
    x, y = data()
    train = table(spark, x, y, FOLDS)
    spec = forests.ForestSpec(trees=25)
    one, two = forests.fit_forests(train, spec), forests.fit_forests(train, spec, task_values=150)
    for run in range(3):
        assert np.allclose(one[run].scores(x), two[run].scores(x))
    held = np.arange(len(y)) % 3 == 0
    assert ((one[0].scores(x[held]) >= 0.5) == y[held]).mean() > 0.75


def test_trees_graft_and_route():
    tree, sub = Tree.root(), Tree.root()
    tree.split(np.array([0]), np.array([0]), np.array([5]))
    sub.split(np.array([0]), np.array([1]), np.array([2]))
    sub.value[:] = [0, 7, 8]
    tree.value[1] = 6
    tree.graft(2, sub)
    bins = np.array([[5, 9], [6, 2], [6, 3]], np.uint8)
    assert tree.value[tree.leaves(bins)].tolist() == [6, 7, 8] and tree.depth() == 2


def test_histograms_and_ties():
    bins, node = np.array([[0, 1], [1, 0], [1, 1]], np.uint8), np.array([0, 0, 1])
    sums = histograms(bins, node, 2, np.array([1.0, 2.0, 4.0]))
    assert sums[0, 0, 0, :2].tolist() == [1, 2] and sums[0, 0, 1, :2].tolist() == [2, 1] and sums[0, 1, :, 1].tolist() == [4, 4]
    same = np.zeros((2, 1, 2, 256))
    same[0, 0, :, 0], same[0, 0, :, 3], same[1, 0, :, 0], same[1, 0, :, 3] = -2, 2, 2, 2
    assert [int(c[0]) for c in best_gain(same, 1, 1)[1:3]] == [0, 0]


def test_nan_features_raise(spark):
    with pytest.raises(ValueError):
        binned(np.array([[np.nan]]), [np.array([1.0])])


def test_cuts_are_values_that_occur(spark):
    x = np.array([[1.0, 5.0], [1.0, 5.0], [2.0, 5.0], [9.0, 5.0]])
    assert [c.tolist() for c in feature_cuts(table(spark, x, np.array([0, 1, 0, 1])))] == [[1.0, 2.0], []]


def brute_isotonic(x, y):
    """Least squares by the min-max formula."""
    values = np.unique(x)
    total = np.array([y[x == v].sum() for v in values], float)
    weight = np.array([(x == v).sum() for v in values], float)
    mean = lambda i, j: total[i : j + 1].sum() / weight[i : j + 1].sum()
    return values, np.array([max(min(mean(i, j) for j in range(k, len(values))) for i in range(k + 1)) for k in range(len(values))])


@pytest.mark.parametrize("slot", [100_000, 7])
def test_isotonic_equals_brute_force(spark, slot):
    rng = np.random.default_rng(3)
    rows = []
    for run in range(3):
        x = np.round(rng.random(150 if run else 40), 2)
        rows += [(run, float(v), int(rng.random() < v)) for v in x]
    curves = isotonic.fit_isotonic(spark.createDataFrame(rows, "run int, score double, label int").repartition(4), slot)
    for run in range(3):
        x, y = (np.array([r[i] for r in rows if r[0] == run]) for i in (1, 2))
        values, fitted = brute_isotonic(x, y)
        assert np.allclose(curves[run](values), fitted)


def test_networks_equal_their_solo_fits(spark):
    x, y = data(90)
    spec = networks.NetworkSpec(hidden=(8, 4), dropouts=(0.3, 0.0), rate=1e-2, epochs=15)
    together = networks.fit_networks(table(spark, x, y, FOLDS), spec)
    for run in range(3):
        own = table(spark, x, y, FOLDS).filter(F.array_contains("runs", run)).withColumn("runs", F.array(F.lit(run)))
        assert np.array_equal(networks.fit_networks(own, spec)[run].scores(x), together[run].scores(x))
    assert ((together[0].scores(x) >= 0.5) == y).mean() > 0.7


def test_network_gradient(monkeypatch):
    x, y = data(12)
    spec = networks.NetworkSpec(hidden=(5, 3), dropouts=(0.0, 0.0), rate=0.0)
    net = networks.Network(4, spec)
    net.weights = net.weights.astype(np.float64)

    def loss(weights):
        a, w = x, net._views(weights)
        for i in range(2):
            z = a @ w[4 * i] + w[4 * i + 1]
            a = np.maximum((z - z.mean(0)) / np.sqrt(z.var(0) + 1e-5) * w[4 * i + 2] + w[4 * i + 3], 0)
        z = a @ w[-2] + w[-1]
        return (np.log(np.exp(z).sum(1)) - z[np.arange(12), y]).mean()

    net.first = np.zeros_like(net.weights)
    net.second = np.zeros_like(net.weights)
    net.step(x, y, np.random.default_rng(0))
    gradient = net.first / 0.1
    for i in range(0, len(net.weights), 3):
        up, down = net.weights.copy(), net.weights.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert gradient[i] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=2e-3)


def test_network_moves_by_adam():
    """The blocks of the update equal Adam with decoupled decay as it is written down."""
    rng = np.random.default_rng(1)
    spec = networks.NetworkSpec(hidden=(300, 200), dropouts=(0.0, 0.0), rate=1e-2, decay=1e-1)
    net = networks.Network(5, spec)
    w, first, second = net.weights.astype(np.float64), 0.0, 0.0
    for step in range(1, 301):
        g = rng.normal(size=len(w)).astype(np.float32) * (np.arange(len(w)) % 3)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g.astype(np.float64) ** 2
        w *= 1 - spec.rate * spec.decay
        w -= spec.rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        net._move(g)
    assert np.allclose(net.weights, w, atol=1e-4)


def test_runs_of_networks_train_at_the_same_time(spark, tmp_path):
    """A run has a task of its own, and tasks don't wait for each other; a run with much work goes to several."""
    x, y = data(96)
    spec = networks.NetworkSpec(hidden=(4,), dropouts=(0.0,), epochs=2)
    train = table(spark, x, y, tuple((i,) for i in range(8)))

    def jobs(work):
        spark.sparkContext.setJobGroup("networks", "networks")
        models = work()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        tracker = spark.sparkContext.statusTracker()
        most = max(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("networks") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s))
        return models, most

    models, most = jobs(lambda: networks.fit_networks(train, spec))
    assert len(models) == 8 and most >= 64
    dealt = networks.fit_networks(train, spec, task_work=4 * len(models[0].weights))
    assert {m.steps for m in dealt.values()} == {2} and {m.steps for m in models.values()} == {2}


def test_sharded_networks_learn(spark):
    x, y = data(200)
    spec = networks.NetworkSpec(hidden=(8,), dropouts=(0.0,), rate=2e-2, epochs=6, batch=16)
    model = networks.fit_networks(table(spark, x, y), spec, task_values=90)[0]
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.65


def test_early_stopping_keeps_the_best(spark):
    x, y = data(100)
    spec = networks.NetworkSpec(hidden=(16,), dropouts=(0.0,), rate=0.1, epochs=60, validation=0.3, patience=3)
    model = networks.fit_networks(table(spark, x, y), spec)[0]
    assert 0 < model.steps < 60 * 4


def test_scaling_by_run(spark):
    x, y = data(60)
    train = table(spark, np.hstack([x, np.full((60, 1), 0.1)]), y, ((0,), (1,)))
    scalers = scaler_of(train)
    own = np.arange(60) % 2 == 1
    assert np.allclose(scalers[1][0][:4], x[own].mean(0)) and np.allclose(scalers[1][1][:4], x[own].std(0)) and scalers[1][1][4] == 0
    rows = scale_rows(train, scalers).filter("runs[0] = 1").orderBy("text_id").collect()
    assert np.allclose([r.x[:4] for r in rows], (x[own] - x[own].mean(0)) / x[own].std(0)) and {r.x[4] for r in rows} == {0.0}


@pytest.mark.parametrize("name, options", [
    ("logreg", {}), ("random_forest", {"trees": 5}), ("gbt", {"rounds": 3}), ("gbt_calibrated", {"rounds": 3}), ("mlp", {"hidden": (4,), "max_iter": 3}),
])
def test_every_classifier_saves_and_loads(spark, tmp_path, name, options):
    x, y = data(120)
    train = table(spark, x, y, FOLDS)
    models = fit_runs(name, train, 1, **options)
    assert set(models) == {0, 1, 2}
    save_models(spark, models, str(tmp_path / "m"), {"metrics": {"roc_auc": 0.5}})
    loaded, facts = load_models(spark, str(tmp_path / "m"))
    assert all(np.array_equal(models[r].scores(x), loaded[r].scores(x)) for r in models) and facts == {"metrics": {"roc_auc": 0.5}}
    rows = scored(train.withColumn("runs", F.array(F.lit(2))), models).collect()
    assert len(rows) == 120 and all(0 <= r.score <= 1 for r in rows)


def test_holdout_saves_model_and_metrics(spark, tmp_path):
    x, y = data(120)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(120)], "text_id long, label int, a double, b double, c double, d double")
    scores = hs.holdout_scores(df, ["a", "b", "c", "d"], ["gbt_calibrated"], options={"gbt_calibrated": {"rounds": 3}}, save_to=str(tmp_path))
    loaded = cl.FittedRun.load(spark, str(tmp_path / "gbt_calibrated"))
    assert loaded.facts["columns"] == ["a", "b", "c", "d"] and 0 <= loaded.facts["metrics"]["roc_auc"] <= 1
    again = {r.text_id: r.score for r in loaded.predict(cl.with_vector(df, ["a", "b", "c", "d"])).collect()}
    held = scores.collect()
    assert len(held) == 24 and all(again[r.text_id] == pytest.approx(r.score) for r in held)


def test_networks_by_column(spark, tmp_path):
    x, y = data(80)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(80)], "text_id long, label int, a double, b double, c double, d double")
    rows = ex.mlp_by_score(df, ["a", "b", "c", "d"], str(tmp_path), options={"mlp": {"max_iter": 20}}).collect()
    assert {r.score_col for r in rows} == set("abcd") and rows[0].roc_auc >= rows[-1].roc_auc
    assert load_models(spark, f"{tmp_path}/mlp_a")[1]["columns"] == ["a"]


def test_forest_trees_are_those_of_one_node_after_another():
    rng = np.random.default_rng(3)
    bins, y = rng.integers(0, 6, (300, 5)).astype(np.uint8), rng.integers(0, 2, 300)
    bins[:, 4] = 0
    weight = forests.bootstrap(rng.integers(-(2**62), 2**62, 300), 42, 0)
    tries = 2
    tree, compact = (t := Grower(bins, y, 42, tries, None).tree(0, weight)), t.compact()
    open_, seen = [(0, 1, np.flatnonzero(weight))], 0
    while open_:
        node, path, rows = open_.pop()
        w, seen = weight[rows], seen + 1
        ones = (w * y[rows]).sum() / w.sum()
        best, split = np.inf, None
        for i, f in enumerate(drawn(42, 0, path, 5)):
            if ones in (0, 1) or i >= tries and split is not None:
                break
            impurity, cut = gini_split(np.bincount(bins[rows, f], w * y[rows], 256), np.bincount(bins[rows, f], w, 256))
            if impurity < best:
                best, split = impurity, (f, cut)
        assert tree.value[node] == ones
        if split is None:
            assert tree.feature[node] == compact.feature[node] == -1 and compact.value[node] == ones
            continue
        assert split == (tree.feature[node], tree.cut[node]) == (compact.feature[node], compact.cut[node])
        right, left = bins[rows, split[0]] > split[1], int(tree.left[node])
        open_ += [(left, child_path(path, False), rows[~right]), (left + 1, child_path(path, True), rows[right])]
    assert seen == len(tree.feature) and (tree.leaves(bins) == compact.leaves(bins)).all()


def test_forest_nodes_grow_together(monkeypatch):
    """A level takes a few calls, whatever the number of its nodes, and a node few bytes."""
    calls = []
    monkeypatch.setattr(trees, "gini_splits", lambda *a, of=trees.gini_splits: calls.append(len(a[0])) or of(*a))
    rng = np.random.default_rng(4)
    bins, y = rng.integers(0, 256, (4000, 8)).astype(np.uint8), rng.integers(0, 2, 4000)
    tree = Grower(bins, y, 42, 2, None).tree(0, np.ones(4000))
    assert len(tree.feature) > 1000 and len(calls) <= 8 * (tree.depth() + 1)
    assert len(pickle.dumps(tree.compact(), 5)) < 12 * len(tree.feature) + 2000


def test_training_does_not_depend_on_the_size(spark):
    """Without being asked, a run of any size is trained batch by batch, early stopping included."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 2))
    y = (x[:, 0] + rng.normal(size=4000) > 0).astype(int)
    spec = networks.NetworkSpec(hidden=(96, 64), dropouts=(0.0, 0.0), rate=1e-2, epochs=3, batch=512, validation=0.2)
    model = networks.fit_networks(table(spark, x, y), spec)[0]
    rows = table(spark, x, y).select("key", "label", "x").orderBy("key").collect()
    a, b, key = np.array([r.x for r in rows], np.float32), np.array([r.label for r in rows]), np.array([r.key for r in rows])
    alone = networks.train_rows(networks.Network(2, spec), a, b, key, 0, 3)
    assert np.array_equal(alone.weights, model.weights)
    defaults = inspect.signature(networks.fit_networks).parameters
    assert defaults["task_values"].default is None and defaults["task_work"].default is None


def test_shards_stop_early(spark):
    """Replicas hold rows back as well, and the best weights are kept."""
    x, y = data(100)
    spec = networks.NetworkSpec(hidden=(16,), dropouts=(0.0,), rate=0.3, epochs=12, validation=0.3, patience=2)
    model = networks.fit_networks(table(spark, x, y), spec, task_values=210)[0]
    assert 0 < model.steps < 12


def test_rows_in_a_file_train_alike(spark, monkeypatch):
    x, y = data(90)
    spec = networks.NetworkSpec(hidden=(8, 4), dropouts=(0.3, 0.0), rate=1e-2, epochs=3)
    kept = networks.train_rows(networks.Network(4, spec), x.astype(np.float32), y, np.arange(90), 0, 3)
    monkeypatch.setattr(networks, "_IN_MEMORY", 0)
    room = networks._room(*x.shape)
    room[:] = x
    assert isinstance(room, np.memmap) and np.array_equal(networks.train_rows(networks.Network(4, spec), room, y, np.arange(90), 0, 3).weights, kept.weights)


def test_small_networks_take_their_steps_together(spark, monkeypatch):
    """Teams of runs with the same rows give the networks that each run gives alone, whenever it stops."""
    x, y = data(120)
    spec = networks.NetworkSpec(hidden=(16, 8), dropouts=(0.3, 0.0), rate=3e-2, epochs=25, batch=16, validation=0.2, patience=3)
    rng = np.random.default_rng(3)
    columns = [x[:, [0]] * (r % 4) / 3 + rng.normal(size=(120, 1)) for r in range(20)]
    rows = [(i, int(y[i]), [r], [float(columns[r][i, 0])]) for r in range(20) for i in range(120)]
    rows += [(i, int(y[i]), [20], [float(x[i, 1])]) for i in range(60)]
    train = spark.createDataFrame(rows, "key long, label int, runs array<int>, x array<double>")
    together = networks.fit_networks(train, spec)
    alone = [networks.train_rows(networks.Network(1, spec), c.astype(np.float32), y, np.arange(120), 0, 25) for c in columns]
    assert len(together) == 21 and len({n.steps for n in alone}) > 1
    for run, net in enumerate(alone):
        assert net.steps == together[run].steps and np.allclose(net.weights, together[run].weights, atol=1e-5)
    calls = []
    monkeypatch.setattr(networks.Network, "_move", lambda self, *a, of=networks.Network._move: calls.append(1) or of(self, *a))
    team = [networks.Network(1, replace(spec, validation=0.0)) for _ in range(5)]
    networks.train_together(team, np.stack(columns[:5]).astype(np.float32), y, np.arange(120), 0, 1)
    assert len(calls) == 8
