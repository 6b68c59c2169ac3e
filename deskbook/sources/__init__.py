"""Readers, writers, schemas and the views that give the test tables the library's shapes."""
