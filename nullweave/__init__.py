"""Maximum-entropy null models of networks, and their statistics, on Spark DataFrames."""
