"""Readers of notes, catalogs and requests."""
