"""Readers and writers of building models: readable JSON, compact JSON, and the binary container."""
