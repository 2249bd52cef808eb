"""Queries over metric points: the versioned store, dashboards and reusable definitions."""
