"""Operators for large training-data corpora.

Nothing else in the library imports this subpackage.  Every operator takes DataFrames and returns
DataFrames; intermediate tables that cut lineage go to the folder named by ``spark.checkpoint.dir``.
"""
