"""Annotators stand in for external services: batches of words in, labels out."""
