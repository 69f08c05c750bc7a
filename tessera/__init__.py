"""tessera: fine-grained table retrieval over data lakes, as Spark DataFrame operators.

A lake is a set of tables; a tile is a rectangle (row set x column set) of one table.
Every operator takes and returns DataFrames and works on all lakes, tables and
questions of its input at once.
"""
