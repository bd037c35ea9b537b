"""Structured Streaming forms of the device and monitoring operators."""
