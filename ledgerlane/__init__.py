"""Purchase-document, warranty and reminder analytics as Spark jobs."""

__version__ = "0.1.0"
