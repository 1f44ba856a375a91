"""strandweave: sequence-graph analytics and training-data operators on Spark DataFrames."""
