"""Journals and outboxes as streams."""
