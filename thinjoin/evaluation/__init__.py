"""Replicated runs and error metrics."""
