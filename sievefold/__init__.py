"""sievefold: sensitive-data discovery, retention and audit analytics as Spark DataFrames."""
