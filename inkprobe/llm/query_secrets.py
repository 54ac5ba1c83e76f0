"""op9: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.llm.registry import query, table
from inkprobe.llm.secrets import MarkovPair, labelled_samples, scan, spans_text


@query("op9_secrets")
def op9_secrets(spark, sf_dir):
    """Fixed patterns and what the Markov models add, over every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, MarkovPair.train(labelled_samples(docs)))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
