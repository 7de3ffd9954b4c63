"""Scans and sinks: paragraphs out of documents, pages and conversations; layout, presets, side tables."""
