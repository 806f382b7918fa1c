"""Readers of folders of frames, and sinks of rolls, events and decisions."""
