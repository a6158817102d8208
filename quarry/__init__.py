"""A document-ingestion and semantic-retrieval engine on PySpark."""
