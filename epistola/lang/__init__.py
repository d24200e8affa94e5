"""The search language: terms, their meaning, and their DataFrame plans."""
