"""Multi-model analytics over DataFrames."""
