"""Corpus operators for training-data pipelines.

Each module holds one operator: it takes DataFrames and returns DataFrames.
``queries`` binds them to the tables that the driver registers.
"""
