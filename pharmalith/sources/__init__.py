"""Readers for landed files and tables, and the sinks that store the relations."""
