"""Inspection of material on rolls as Spark jobs: positions, tiles, scores, thresholds, events, grading, evaluation, live streams."""
