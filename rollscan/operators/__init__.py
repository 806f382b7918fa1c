"""Operators of the inspection library."""
