"""The registry, and a few quick queries against their SQL; ``tools/check.py`` runs all."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ["clean_text", "melt_binary_text", "parse_vector_string", "pawn_metrics", "evaluate_scores", "main_tables", "metric_auc"]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "conversations", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(tuple(plain(v) for v in r) for r in result.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*names).collect()) == theirs


def test_learning_queries_run_whole_jobs(spark, monkeypatch):
    """Default sizes, all strategies and classifiers, all columns and whole corpora; nothing is fitted here."""
    from inkprobe.catalog import learning

    calls = {}

    def record(module, name, result=lambda *a: spark.range(1)):
        monkeypatch.setattr(module, name, lambda *a, **b: (calls.setdefault(name, []).append((a, b)), result(*a))[1])

    record(learning.hs, "holdout_eval")
    record(learning, "evaluate_strategy")
    record(learning.ex, "tune_masking")
    record(learning.ex, "mlp_by_score", lambda *a: spark.createDataFrame([("a/b",)], "model_path string"))
    record(learning.ex, "run_experiment", lambda *a: (spark.range(1), None))
    names = ["classifier_random_forest", "classifier_gbt", "classifier_gbt_calibrated", "classifier_mlp", "holdout_eval"]
    for name in [*names, "strategy_score", "strategy_pawn", "tune_masking", "mlp_by_score", "run_experiment"]:
        entry.queries()[name](spark, SF)
    assert not any(b for made in calls.values() for _, b in made)
    assert [a[3] for a, _ in calls["evaluate_strategy"]] == [["logreg", "random_forest", "gbt", "gbt_calibrated"], ["logreg", "mlp"]]
    assert len(calls["tune_masking"][0][0]) == 2
    width = len(spark.read.parquet(f"{SF}/embeddings.parquet").first().embedding)
    assert len(calls["mlp_by_score"][0][0][1]) == width
    specs = [a[1] for a, _ in calls["run_experiment"]]
    assert [list(s.strategies) for s in specs] == [["score", "pawn", "embedding"], ["score", "pawn", "embedding", "zero_shot"]]
    con = duckdb.connect()
    turns, quality = (
        2 * con.execute(f"SELECT min(n) FROM (SELECT count(*) AS n FROM {rows} GROUP BY k)").fetchone()[0]
        for rows in (
            f"(SELECT role AS k FROM '{SF}/conversations.parquet' WHERE role IN ('user', 'assistant'))",
            f"(SELECT quality AS k FROM '{SF}/labels.parquet' JOIN '{SF}/documents.parquet' USING (doc_id))",
        )
    )
    assert {k: load(specs[0].n_total, 41).count() for k, load in specs[0].datasets.items()} == {"turns": turns, "quality": quality}
