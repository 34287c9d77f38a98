"""heddle: a text-corpus analytics engine on Spark DataFrames."""
