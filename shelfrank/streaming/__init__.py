"""Structured Streaming: arriving queries searched against a static catalog (M1)."""
