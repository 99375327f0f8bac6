"""Operators of the engine: DataFrame in, DataFrame out, on generic column names."""
