"""From filters to DataFrames."""
