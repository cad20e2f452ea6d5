"""Operators of a training-data pipeline (text dedup, filters, packing, token files)."""
