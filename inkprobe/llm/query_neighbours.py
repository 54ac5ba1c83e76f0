"""op2: nearest neighbours of every twentieth vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.llm.prefix_forest import nearest
from inkprobe.llm.registry import query, table


@query("op2_prefix_forest")
def op2_prefix_forest(spark, sf_dir):
    """The 20 nearest of all vectors for each vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)
