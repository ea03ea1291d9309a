"""folioforge: retrieval and corpus analytics for document libraries, on Spark DataFrames."""
