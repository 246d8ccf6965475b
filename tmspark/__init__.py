"""Spark jobs for translation-memory and OCR-text tables."""
