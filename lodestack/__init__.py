"""Content-addressed dataset algebra and training-data operators on PySpark."""
