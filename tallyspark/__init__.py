"""Point-in-time contest analytics and training-data operators on Spark DataFrames."""
