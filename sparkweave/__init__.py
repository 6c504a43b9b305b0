"""Text retrieval, question answering evaluation and vector search as Spark plans."""
