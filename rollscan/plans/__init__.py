"""The registered queries and the views they read."""
