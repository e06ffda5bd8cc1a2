"""Readers, writers, and what vendors' column names stand for."""
