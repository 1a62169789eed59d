"""Batch analytics over the printed evidence of scanned maps, on PySpark."""
