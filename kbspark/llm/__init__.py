"""Operators of a training-data pipeline, their queries and the SQL that checks them."""
