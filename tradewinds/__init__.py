"""Spark-first analytics over item-level trade declarations and any header/item transaction data."""
