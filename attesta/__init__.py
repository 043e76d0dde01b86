"""Evidence analytics on Spark: DataFrame operators over curated evidence tables."""
