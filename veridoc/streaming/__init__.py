"""Streaming extensions; the batch form is the reference for tests."""
