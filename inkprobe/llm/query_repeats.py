"""op6: repeated passages of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.llm.registry import query, table
from inkprobe.llm.suffix_dedup import remove_repeats


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    """Strings of 100 bytes over every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = remove_repeats(docs, length=100, keep=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
