"""Finding, tokenizing and restoring personal data in text with Spark DataFrames."""
