"""millrace: Spark-first data preparation and evaluation of text and web corpora."""
