"""Graph, join, aggregate, ranking and set operators over the fact tables. Each takes and returns DataFrames."""
