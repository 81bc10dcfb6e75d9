"""Operators of a training-data pipeline over tables of texts; nothing else in the package imports this one."""
