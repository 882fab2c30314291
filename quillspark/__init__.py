"""quillspark: corpus cleaning, structuring, chunking, retrieval and evaluation as Spark DataFrame jobs."""

__version__ = "0.1.0"
