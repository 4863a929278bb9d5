"""Operators of a training-data pipeline: text in, decisions out, one module per operator."""
