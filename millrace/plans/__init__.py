"""Declared questions: filter trees, search modes and the views over facts."""
