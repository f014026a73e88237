"""Cueline: analytics over time-coded text, written for Spark DataFrames."""
