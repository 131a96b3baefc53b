"""Training-data operators: scoring, deduplication, search, redaction, mixing and packing.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, keeps state only in Spark shuffles or in tables under the cluster's
shared checkpoint folder, and never collects per-document data to the driver.
"""
