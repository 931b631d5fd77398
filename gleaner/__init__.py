"""Gleaner: DataFrame operators for collecting, filtering, scoring and ranking text records."""
