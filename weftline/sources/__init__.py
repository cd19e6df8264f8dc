"""Readers: diffs, histories and recorded model responses."""
