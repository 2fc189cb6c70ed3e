"""Scalar plans, and the queries and SQL by which the engine is checked."""
