"""Code intelligence and corpus analytics on Spark."""

from .api import Workspace
from .operators import analysis, bm25, context, embedding, fusion, graph, topology
from .operators.index import IndexMissing, SourceIndex
from .session import build

__all__ = ["IndexMissing", "SourceIndex", "Workspace", "analysis", "bm25", "build", "context", "embedding", "fusion", "graph", "topology"]
