"""Knowledge graphs from conversations and documents, as Spark DataFrames."""
