"""Telemetry analytics as Spark DataFrame operators: metrics, logs, traces and their ingestion."""
