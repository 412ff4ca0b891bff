"""Operators of a training-data pipeline; nothing else in nearfield imports this package."""
