"""Incremental versions of the audit and of the progress report."""
