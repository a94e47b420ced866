"""quillion: document analytics as PySpark DataFrame operators."""
