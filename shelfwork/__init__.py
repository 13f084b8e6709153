"""Batch jobs for a game catalogue and its users' backlogs, on Spark DataFrames."""
