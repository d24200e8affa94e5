"""Epistola: search and audit of message archives with PySpark."""
