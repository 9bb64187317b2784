"""signalbox: agent-traffic governance and analytics as plain Spark DataFrame jobs.

Captured JSON-RPC messages are parsed, checked against rules, redacted, joined
with review decisions, correlated with their tool listings and reported on.
Everything is a function from DataFrame to DataFrame, usable in batch and, for
the stateless stages, on streams.
"""
