"""Training-data operators: ten corpus operations on Spark DataFrames.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
