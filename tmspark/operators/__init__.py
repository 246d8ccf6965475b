"""Batch operators: tables in, tables out, no actions inside."""
