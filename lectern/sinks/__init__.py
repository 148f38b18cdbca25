"""Sinks: tables that are written once, replaced, appended to or published as a whole."""
