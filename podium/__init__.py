"""Podium: sports-meet analytics as functions from DataFrames to DataFrames."""
