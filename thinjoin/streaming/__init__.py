"""Samplers on streams.

The universe and Bernoulli filters keep no state: whether a row is kept depends on the row, the seed and the rates
only. ``operators.sampling.sample_side`` therefore takes a streaming DataFrame as it takes a batch one, and a stream
of new rows can be thinned into the stored sample with ``writeStream``. Rates must be literal there (``Rates``),
because a stream cannot plan from statistics it has not seen.
"""
