"""Training-data operators: ten large-scale corpus operations over DataFrames."""
