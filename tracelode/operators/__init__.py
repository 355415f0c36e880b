"""Operators over DataFrames of the data model."""
