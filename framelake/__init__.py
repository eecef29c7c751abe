"""framelake: trajectory, event-sequence and dataset analytics as Spark DataFrames."""
