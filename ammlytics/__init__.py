"""ammlytics: trade-tape analytics and research operators as Spark DataFrames."""
