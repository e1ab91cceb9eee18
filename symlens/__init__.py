"""symlens: code-symbol analytics and training-data operators on Spark DataFrames."""
