"""Recall and supply-risk analytics on Spark."""
