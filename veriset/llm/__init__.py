"""Operators of a training-data pipeline: one module each, with its query beside it."""
