"""Set-at-a-time analytics over collections of small tables and the dialogues about them, on Spark DataFrames."""
