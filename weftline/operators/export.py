"""A summary of an index as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import topology


def summary(stats: dict, scores: DataFrame, files: DataFrame, symbols: DataFrame, top: int = 10, most: int = 50) -> str:
    """Counts, the files of highest rank, and the first symbols in order of scoped name."""
    ranked = topology.top_files(scores, files, top).select(F.format_string("- %s (score %.4f)", "id", "score").alias("t")).collect()
    named = symbols.groupBy("scoped_name").agg(F.min("kind").alias("kind")).orderBy("scoped_name").limit(most).select(F.format_string("- %s [%s]", "scoped_name", "kind").alias("t")).collect()
    parts = ["# Index", *(f"{k}: {v}" for k, v in stats.items()), "", "## Files by rank", *(r["t"] for r in ranked), "", "## Symbols", *(r["t"] for r in named)]
    return "\n".join(parts)
