"""Structured Streaming forms of the spectrum operators (an extension: the batch operators don't need it)."""
