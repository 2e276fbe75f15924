"""Operators: pure DataFrame -> DataFrame (or -> scalar) functions."""
