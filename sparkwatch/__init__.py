"""Spark-native telemetry detection: grids, baselines, forecasts, scoring, labels."""

__version__ = "0.1.0"
