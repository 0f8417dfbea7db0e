"""Event operators on Structured Streaming, each with the answer of its batch form."""
