"""Multimodal chat data preparation as Spark DataFrame jobs."""
