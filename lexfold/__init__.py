"""Clause analytics on PySpark: segmentation, curation, evaluation and retrieval as DataFrame functions."""
