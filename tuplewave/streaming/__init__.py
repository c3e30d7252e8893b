"""Continuous queries: subscriptions, micro-batch evaluation, Structured Streaming."""
