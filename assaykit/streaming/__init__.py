"""Structured Streaming forms of the stateful operators, each with a batch twin to test against."""
