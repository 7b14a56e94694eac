"""docspark: document queries, pipelines and tables on Spark."""
