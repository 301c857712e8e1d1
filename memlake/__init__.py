"""memlake: a PySpark library for storing, versioning, deduplicating and retrieving large
collections of short text facts, with batch (table-level) search, graph, temporal and write-path
operators.  Every operator takes DataFrames and returns DataFrames."""

__version__ = "0.1.0"
