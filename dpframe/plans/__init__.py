"""Registered queries (one per operator) and their oracle SQL."""
