"""The row-wise jobs on streaming DataFrames."""
