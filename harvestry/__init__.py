"""harvestry: curating crawled web data with Spark DataFrames."""
