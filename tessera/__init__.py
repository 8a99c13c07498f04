"""Session analytics on Spark DataFrames: windows, joins, statistics, evaluation, decisions, streams."""
