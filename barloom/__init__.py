"""barloom: causal market-bar research operators on Spark DataFrames."""
