"""Operators of a training-data pipeline: text and vector work at corpus scale."""
