"""Operators for training-data pipelines. Nothing outside this folder imports it.

Every operator takes and returns DataFrames. Where the built-in functions cannot say what an operator
does, tasks work on Arrow batches; the package must then be on the executors' Python path.
"""
