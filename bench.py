"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The count-model queries run over every document (10,000 at sf0.1, whole texts) and include
everything: vocabulary, counts, metrics. Results go to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from inkprobe import catalog  # noqa: E402
from inkprobe.catalog.tokens import texts  # noqa: E402
from inkprobe.plans.backbones import CountModel, CountSpec  # noqa: E402
from inkprobe.session import local_session  # noqa: E402


def count_model(paradigm: str, method: str):
    def run(spark, sf_dir):
        docs = texts(spark, sf_dir)
        model = CountModel.cross_fit(CountSpec(paradigm), docs)
        if method != "embed":
            return getattr(model, method)(docs)
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
        return model.embed(docs, vectors)

    return run


HEADLINE = {
    "causal_score": count_model("causal", "score"),
    "causal_pawn": count_model("causal", "pawn_metrics"),
    "masked_pawn": count_model("masked", "pawn_metrics"),
    "diffusion_pawn": count_model("diffusion", "pawn_metrics"),
    "diffusion_embedding": count_model("diffusion", "embed"),
    **{
        name: catalog.QUERIES[name]
        for name in (
            "clean_text", "balanced_sample", "stratified_kfold", "position_metrics", "direct_score_eval",
            "roc_auc_many_scores", "pivot_best", "cross_validated_eval", "metric_auc",
        )
    },
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.length("text"))).collect()  # starts the JVM
    spent = {}
    for name in names:
        began = time.perf_counter()
        HEADLINE[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(spent.values()), 3),
        "unit": "sec",
        "queries": spent,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
