"""The numbered queries, each of which applies one operator to its whole table, and the pipeline."""

import corpus_pipeline
from inkprobe.llm import (  # noqa: F401
    query_collocations,
    query_copies,
    query_runs,
    query_decontamination,
    query_html,
    query_mixing,
    query_neighbours,
    query_ngrams,
    query_repeats,
    query_secrets,
    query_sharding,
    query_toxicity,
    query_warc,
)
from inkprobe.llm.registry import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
