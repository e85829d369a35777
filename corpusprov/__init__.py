"""Corpus-provenance analytics on Spark.

Everything takes DataFrames and returns DataFrames; no module keeps a session.
"""

__version__ = "0.1.0"
