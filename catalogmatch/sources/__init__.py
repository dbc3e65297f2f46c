"""Readers, file jobs and writers."""
