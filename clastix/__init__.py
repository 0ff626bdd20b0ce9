"""Auditing and repair of interval-dated, hierarchically classified records, on PySpark."""
