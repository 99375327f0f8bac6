"""Scalar functions of the engine, all as Column expressions."""
