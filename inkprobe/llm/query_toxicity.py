"""op5: toxicity scores of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.llm.registry import query, table
from inkprobe.llm.toxicity import flagged, learn, score


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    """Learned from the labelled documents that aren't held out, applied to every whole text."""
    documents = table(spark, sf_dir, "documents")
    model = learn(documents, table(spark, sf_dir, "labels"), "toxic")
    scored = score(documents.select("doc_id", "lang", "text"), model, keep=["doc_id", "lang"])
    held_out = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
        flagged(model).alias("flagged"),
    )
