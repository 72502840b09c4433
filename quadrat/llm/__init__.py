"""Training-data operators: one module per operator, plus their driver queries.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, keeps its own column names under parameters, ignores any other
column of its input (whatever its name), and states in its docstring what nulls,
empty and very long texts, ties, repeated rows and empty tables give.
"""
