"""Structured Streaming forms of the metric, step-log and encoding jobs."""
