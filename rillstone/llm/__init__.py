"""Operators for training data: term statistics, similar sets, co-occurrence, leakage, mixing and abuse scores."""
