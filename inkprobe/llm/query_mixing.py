"""op8: documents mixed to source weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.llm.mixing import mix
from inkprobe.llm.registry import query, table


@query("op8_mixing")
def op8_mixing(spark, sf_dir):
    """Sources weigh 5, 2, 1 in turn and stop at three times their size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs, weights=(5, 2, 1), most=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
