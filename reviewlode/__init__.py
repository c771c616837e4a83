"""Review mining on Spark: from stored web pages to sentiment and topic tables."""
