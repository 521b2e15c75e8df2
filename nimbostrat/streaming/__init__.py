"""Streaming forms of stateful operators."""
