"""Catalog matching at table scale: PySpark operators over catalog, vector, detection, question and scan tables."""
