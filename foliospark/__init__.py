"""foliospark: document analytics on Spark DataFrames.

A document is a row, an operator output is a column, and a list-valued output
is an array of structs or an exploded child DataFrame.
"""
