"""Readers of tables, folders and image bytes."""
