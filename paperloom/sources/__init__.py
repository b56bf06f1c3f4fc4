"""Readers that turn files, tables and pages into unit tables, and the chunk-table sink."""
