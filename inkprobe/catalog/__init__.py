"""Queries over the test tables, each with the SQL that must give the same rows."""

from inkprobe.catalog import (  # noqa: F401
    backbones,
    cleaning,
    evaluation,
    fits,
    learning,
    metrics,
    reports,
    sampling,
    sources,
    tokens,
)
from inkprobe.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
