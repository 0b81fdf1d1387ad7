"""Seeded generators of problems: scenes and their edits, charts and theirs."""
