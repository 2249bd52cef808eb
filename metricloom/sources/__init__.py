"""Readers and writers for inference tables and results."""
