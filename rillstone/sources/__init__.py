"""Readers of the review data and writers of results and models."""
