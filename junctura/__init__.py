"""junctura: junction-graph analytics of many genomes, declared as Spark DataFrames."""
