"""Graph and set operators on DataFrames."""
