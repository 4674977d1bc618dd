"""A text-retrieval and analytics engine whose operators are Spark plans."""
