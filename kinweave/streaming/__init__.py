"""Micro-batched maintenance of graphs kept in parquet."""
