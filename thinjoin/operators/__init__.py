"""Statistics, exact answers, samplers and estimators."""
