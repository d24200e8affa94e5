"""Readers of mail folders and writers of restored mail."""
