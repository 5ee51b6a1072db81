"""Operators on DataFrames: presence matrices, nearest neighbours, trace gathering, column pruning."""
