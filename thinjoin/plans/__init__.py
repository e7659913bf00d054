"""Sampling-rate planners: moments in, one row of rates out."""
