"""Functions of the inspection library."""
