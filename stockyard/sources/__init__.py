"""Readers, writers and the views that stand in for the domain tables."""
