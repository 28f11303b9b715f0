"""Quillon: text-retrieval pipelines and corpus operations as Spark DataFrame plans."""
