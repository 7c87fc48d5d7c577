"""bracken: document analytics, hybrid retrieval and keyed state, declared on Spark DataFrames."""
