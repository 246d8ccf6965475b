"""Readers and writers of page documents, tables, listings and logs."""
