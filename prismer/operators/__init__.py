"""Index, pseudoalignment, graph and statistics operators: functions from DataFrames to DataFrames."""
