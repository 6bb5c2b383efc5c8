"""Incremental forms: resume, last success wins, file streams."""
