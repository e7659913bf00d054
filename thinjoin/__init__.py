"""Approximate COUNT, SUM and AVG over joins, from small samples, as Spark jobs.

The package is a set of DataFrame -> DataFrame operators:

``operators``   per-key statistics, moments, exact answers, samplers, estimators
``plans``       closed-form choice of sampling rates from the moments
``functions``   Column expressions: hashing, predicates, variance formulas, variates
``sources``     delimited text, sample and statistics tables, synthetic tables
``evaluation``  replicated runs and error metrics
``streaming``   how the samplers apply to streaming DataFrames
"""

from thinjoin.functions.rates import Rates
from thinjoin.operators.estimate import approx_join_agg, estimates
from thinjoin.operators.exact import exact_join_agg
from thinjoin.operators.keystats import key_counts, key_stats
from thinjoin.operators.moments import moments
from thinjoin.operators.sampling import SamplePair, sample_pair

__all__ = [
    "Rates",
    "SamplePair",
    "approx_join_agg",
    "estimates",
    "exact_join_agg",
    "key_counts",
    "key_stats",
    "moments",
    "sample_pair",
]
