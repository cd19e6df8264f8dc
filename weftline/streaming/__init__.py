"""Incremental processing of arriving change sets."""
