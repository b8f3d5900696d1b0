"""A PySpark analytics engine for retrieval-augmented generation experiments."""
