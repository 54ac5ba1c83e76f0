import pytest
from pyspark.sql import functions as F

from inkprobe.sources import corpora, results as rs


def test_loaders_without_an_id_column(spark, tmp_path):
    plain = spark.createDataFrame([("a  b", 1), ("a  b", 1), (None, 0), ("", 0)], "text string, label int")
    plain.write.parquet(str(tmp_path / "plain"))
    rows = corpora.load_plain(spark, str(tmp_path / "plain")).collect()
    # Repeated rows stay, with keys of their own; null text goes, empty text stays.
    assert sorted((r.text, r.label) for r in rows) == [("", 0), ("a b", 1), ("a b", 1)]
    assert len({r.row_key for r in rows}) == 3
    flipped = corpora.load_inverted(spark, str(tmp_path / "plain")).collect()
    assert sorted(r.label for r in flipped) == [0, 0, 1]
    assert corpora.load_plain(spark, str(tmp_path / "plain"), n_total=2).count() == 2


def test_loaders_of_other_layouts(spark, tmp_path):
    spark.createDataFrame([("x", "human"), ("y", "gpt"), ("z", None)], "generation string, model string").write.parquet(str(tmp_path / "g"))
    assert {r.text: r.label for r in corpora.load_generation(spark, str(tmp_path / "g")).collect()} == {"x": 1, "y": 0, "z": 0}
    spark.createDataFrame([("human", "x"), ("ai", "y")], "source string, text string").write.parquet(str(tmp_path / "s"))
    assert {r.text: r.label for r in corpora.load_source(spark, str(tmp_path / "s")).collect()} == {"x": 1, "y": 0}
    wide = spark.createDataFrame([(7, "h", "m", "e")], "id bigint, human_output string, model_output string, human_edits string")
    wide.write.parquet(str(tmp_path / "w"))
    rows = corpora.load_paired(spark, str(tmp_path / "w"), id_col="id").collect()
    assert sorted((r.row_key, r.text, r.label) for r in rows) == [("7|0", "m", 0), ("7|1", "h", 1)]


def test_csv_source(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,text,label\n1,"two\nlines",1\n2,plain,0\n')
    rows = corpora.load_plain(spark, str(tmp_path / "c.csv"), id_col="id").collect()
    assert sorted((r.row_key, r.text) for r in rows) == [(1, "two lines"), (2, "plain")]


def test_result_files(spark, tmp_path):
    assert rs.read_results_many(spark, [str(tmp_path / "no.csv")]) is None
    assert rs.read_with_provenance(spark, str(tmp_path)) is None
    (tmp_path / "bad.csv").write_text("a,b\n1,2.5\nx,y\n3,4.5\n")
    lenient = rs.read_csv_lenient(spark, str(tmp_path / "bad.csv"), ["a", "b"])
    assert lenient.agg(F.sum(F.expr("try_cast(b AS double)"))).first()[0] == 7.0
    header = "dataset,model,strategy,time_seconds,vram_peak_gb,cpu_ram_delta_gb,cached\n"
    (tmp_path / "one_performance.csv").write_text(header + "d,m,s,1.5,0.0,0.1,False\n")
    (tmp_path / "two_performance.csv").write_text(header + "d,m,s,2.5,,,True\n")
    rows = {r.experiment: r for r in rs.read_with_provenance(spark, str(tmp_path)).collect()}
    assert rows["one"].cached is False and rows["two"].time_seconds == 2.5 and rows["two"].vram_peak_gb is None


def test_per_text_operators_run_on_a_stream(spark, tmp_path):
    from inkprobe.operators.reshape import clean_text
    from inkprobe.operators.tokens import tokenize

    spark.createDataFrame([(1, " a  B ")], "i int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i int, text string").parquet(str(tmp_path / "in"))
    out = tokenize(clean_text(stream))
    run = out.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("cleaned").first().tokens == ["a", "b"]


def test_lenient_csv_sees_the_same_rows_for_any_columns(spark, tmp_path):
    from inkprobe.sources.results import read_csv_lenient

    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\nx,4\n5,6,7\n8,9,10,11\n")
    rows = read_csv_lenient(spark, str(tmp_path / "x.csv"), ["a", "b"])
    assert sorted(map(tuple, rows.collect()), key=str) == [("1", "2"), ("3", None), ("x", "4")]
    assert rows.count() == rows.select("a").count() == len(rows.select("b").collect()) == 3


def test_staging_needs_a_shared_folder(monkeypatch):
    from inkprobe import session

    class Conf:
        def __init__(self, values):
            self.get = lambda k, d=None: values.get(k, d)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    assert session.staging_root(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/")) == "hdfs://x"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError):
            session.staging_root(Session(spark_master=master))
    assert session.staging_root(Session(spark_master="local[2]"))


def test_staged_tables_can_be_discarded(spark):
    import os

    from inkprobe import session

    session.stage(spark.range(3), "x").collect()
    folder = session._staged[-1]
    assert os.path.isdir(folder)
    assert session.discard_staged(spark) > 0 and not os.path.exists(folder)


def test_first_row_in_file_order_wins_a_tie(spark, tmp_path):
    from inkprobe.operators.reporting import best_classifier
    from inkprobe.sources import results as rs

    paths = []
    for i, names in enumerate((["zeta", "eta"], ["alpha", "beta"])):
        path = tmp_path / f"r{i}.csv"
        lines = [f"d,m,s,{n},0.{7 if n != 'eta' else 6},0,0,0,0" for n in names]
        path.write_text("dataset,model,strategy,classifier,roc_auc,accuracy,f1,recall,precision\n" + "\n".join(lines))
        paths.append(str(path))
    best = lambda order: best_classifier(rs.read_results_many(spark, order, positions=True), ["model"], rs.FILE_ORDER).first().classifier
    assert best(paths) == "zeta" and best(paths[::-1]) == "alpha"
    assert rs.read_results(spark, paths[0]).columns == [c.split()[0] for c in rs.RESULTS.split(", ")]
