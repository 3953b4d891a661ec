"""Question labelling, complexity datasets, TF-IDF probes and experiment rollups on Spark DataFrames."""
