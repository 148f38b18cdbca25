"""Lectern: document review and training-data operators as Spark plans."""
