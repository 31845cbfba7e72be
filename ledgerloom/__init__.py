"""Ledger analytics on Spark: plain ``DataFrame -> DataFrame`` operators on the public PySpark API."""
