"""promptloom: prompt-search evaluation and analysis as Spark DataFrame plans."""
