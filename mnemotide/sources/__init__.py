"""Readers of exports, logs and files, and writers of derived tables and reports."""
