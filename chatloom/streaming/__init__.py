"""Structured Streaming jobs; every rule is the batch operator of the same name."""
