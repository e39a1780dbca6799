"""Sensor time-series analytics as functions from DataFrames to DataFrames."""
