"""Likeloom: feed ranking over a user-post like graph, expressed in Spark DataFrames."""
