"""The same jobs over payloads that keep arriving."""
