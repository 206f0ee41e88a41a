"""brindle: a document retrieval and evaluation engine on the DataFrame API of Apache Spark."""
