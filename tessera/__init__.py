"""tessera: near-duplicate detection and entity resolution on Spark DataFrames."""
