"""User-level operators on ordered tables."""
