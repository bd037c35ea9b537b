"""Operators: DataFrame in, DataFrame out. Every time-dependent one takes `as_of`."""
