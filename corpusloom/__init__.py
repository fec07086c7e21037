"""corpusloom: batch retrieval, evidence filtering and cited answers over document corpora on Spark."""
