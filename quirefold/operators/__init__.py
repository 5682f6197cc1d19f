"""Chunking operators over the documents and pages frames."""
