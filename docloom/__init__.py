"""Structured-document analytics on Spark."""
