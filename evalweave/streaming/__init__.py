"""Structured Streaming: ledgers that grow, and figures by event time."""
