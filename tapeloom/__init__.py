"""tapeloom: price-tape features and embeddings as Spark DataFrame jobs."""

__version__ = "0.1.0"
