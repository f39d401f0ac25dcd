"""Operators of a training-data pipeline. Nothing else in marketloom imports this subpackage."""
