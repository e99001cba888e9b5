"""Continuous aggregation of event streams into cubes: an addition; batch cubes don't need it."""
