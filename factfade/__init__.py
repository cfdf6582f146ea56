"""Spark jobs over tables of facts that age.

Entities, timestamped observations, relations, events, embeddings and usage
logs go in as DataFrames; DataFrames come out.  See README.md for the map.
"""

from factfade.model import Memory
from factfade.session import configure, materialize

__all__ = ["Memory", "configure", "materialize"]
