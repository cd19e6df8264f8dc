"""Relational operators over hunks, commits, plans and scores."""
