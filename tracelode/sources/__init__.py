"""Readers of session stores and writers of results."""
