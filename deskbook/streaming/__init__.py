"""Stateful and incremental jobs on streams."""
