"""Corpus loaders and result files."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.catalog.registry import (
    QUALITY_SQL, TOXICITY_SQL, TURNS_SQL, clean_sql, pair_rows, quality_rows, query, r6, scratch, table, toxicity_rows,
    turn_rows,
)
from inkprobe.functions.text import parse_vector
from inkprobe.operators.reporting import best_classifier
from inkprobe.sources import corpora, results as rs


def _file(spark, df, name) -> str:
    path = scratch(spark, name)
    df.write.parquet(path)
    return path


@query("load_plain", f"WITH {QUALITY_SQL} SELECT * FROM quality")
def load_plain(spark, sf_dir):
    return corpora.load_plain(spark, _file(spark, quality_rows(spark, sf_dir), "plain"), id_col="id")


@query("load_generation", f"WITH {TURNS_SQL} SELECT * FROM turns")
def load_generation(spark, sf_dir):
    rows = turn_rows(spark, sf_dir).select(
        "id", F.col("text").alias("generation"), F.when(F.col("source") == "human", "human").otherwise("bot").alias("model")
    )
    return corpora.load_generation(spark, _file(spark, rows, "generation"), id_col="id", id_type="string")


@query("load_source", f"WITH {TURNS_SQL} SELECT * FROM turns")
def load_source(spark, sf_dir):
    return corpora.load_source(spark, _file(spark, turn_rows(spark, sf_dir), "source"), id_col="id", id_type="string")


PAIRS_SQL = f"""pairs AS (
  SELECT u.conv_id || '-' || u.turn AS id, u.text AS human_output, a.text AS model_output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


@query(
    "load_paired",
    f"""WITH {PAIRS_SQL}
SELECT id || '|1' AS row_key, {clean_sql('human_output')} AS text, 1 AS label FROM pairs
UNION ALL SELECT id || '|0', {clean_sql('model_output')}, 0 FROM pairs""",
)
def load_paired(spark, sf_dir):
    return corpora.load_paired(spark, _file(spark, pair_rows(spark, sf_dir), "pairs"), id_col="id", id_type="string")


@query("load_inverted", f"WITH {TOXICITY_SQL} SELECT * FROM toxicity")
def load_inverted(spark, sf_dir):
    return corpora.load_inverted(spark, _file(spark, toxicity_rows(spark, sf_dir), "inverted"), id_col="id")


@query(
    "parse_vector_string",
    """SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, round(unnest(embedding)::DOUBLE, 6) AS value
FROM embeddings""",
)
def parse_vector_string(spark, sf_dir):
    """Every vector printed with doubled blanks or with commas and line breaks, then parsed."""
    printed = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(
            F.col("label") < 5,
            F.concat(F.lit("[ "), F.array_join(F.col("embedding").cast("array<string>"), "  "), F.lit("]")),
        )
        .otherwise(F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ", \n"), F.lit("]")))
        .alias("printed"),
    )
    parsed = printed.select("vec_id", F.posexplode(parse_vector(F.col("printed"))).alias("pos", "value"))
    return parsed.select("vec_id", F.col("pos").cast("bigint").alias("pos"), r6(F.col("value").cast("double")).alias("value"))


_TIED = """ordered AS (
  SELECT l_linenumber % 2 AS source, 'lines' AS dataset, 'm' || (l_suppkey % 5) AS model, l_returnflag AS strategy,
    (l_suppkey % 3) || ' ' || l_linestatus || ' ' || l_linenumber AS classifier, round(avg(l_discount)::DOUBLE, 2) AS roc_auc, sum(l_quantity) AS place
  FROM lineitem GROUP BY ALL)"""


@query(
    "first_on_ties",
    f"""WITH {_TIED}
SELECT model, strategy, classifier, roc_auc FROM ordered
QUALIFY row_number() OVER (PARTITION BY model, strategy ORDER BY roc_auc DESC, source, place, classifier) = 1""",
)
def first_on_ties(spark, sf_dir):
    """Two result files whose rows often tie: the first one in file order wins, whatever its name."""
    lines = table(spark, sf_dir, "lineitem")
    name = F.concat_ws(" ", (F.col("l_suppkey") % 3).cast("string"), "l_linestatus", F.col("l_linenumber").cast("string"))
    rows = lines.groupBy(
        (F.col("l_linenumber") % 2).alias("source"), F.lit("lines").alias("dataset"), F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string")).alias("model"), F.col("l_returnflag").alias("strategy"), name.alias("classifier")
    ).agg(F.round(F.avg("l_discount").cast("double"), 2).alias("roc_auc"), F.sum("l_quantity").alias("place"))
    paths = []
    for source in (0, 1):
        own = rows.filter(F.col("source") == source).orderBy("place", "classifier").coalesce(1)
        columns = [F.col(c) if c in rows.columns else F.lit(0.0).alias(c) for c in ("dataset", "model", "strategy", "classifier", "roc_auc", "accuracy", "f1", "recall", "precision")]
        paths.append(rs.write_results(own.select(*columns), None, f"{scratch(spark, 'tied')}/results"))
    best = best_classifier(rs.read_results_many(spark, paths, positions=True), ["model", "strategy"], rs.FILE_ORDER)
    return best.select("model", "strategy", "classifier", "roc_auc")
