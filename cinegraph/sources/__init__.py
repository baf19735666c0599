"""Inputs and outputs: CSV / Parquet readers, the test-data adapters, table sinks."""
