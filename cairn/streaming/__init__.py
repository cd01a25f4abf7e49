"""Event operators as Structured Streaming; each has a batch twin in cairn.operators.events."""
