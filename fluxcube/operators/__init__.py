"""Operators on cubes: functions from cubes to cubes, lazy unless raising on the data is their contract."""
