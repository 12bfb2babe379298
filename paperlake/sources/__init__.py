"""Readers for landed feed pages, run tables and response tables."""
