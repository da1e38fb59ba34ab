"""Operators over DataFrames that know nothing of tables: survival, ranking and estimation."""
