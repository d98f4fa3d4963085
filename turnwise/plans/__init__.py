"""Whole evaluations, and the registry of checked queries."""
