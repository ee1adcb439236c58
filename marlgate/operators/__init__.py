"""marlgate.operators: data-processing operators on DataFrames."""
