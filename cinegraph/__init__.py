"""cinegraph: movie recommendation and semantic search as Spark DataFrame jobs.

Layout
------
sources/    readers for raw inputs (CSV / Parquet), test-data adapters, sinks
functions/  native Column expressions (text normalisation, parsing, vectors)
operators/  DataFrame-in / DataFrame-out operators (ETL, graph, signals, search)
plans/      the table catalog (materialised build outputs) and the named queries
"""

from cinegraph.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
