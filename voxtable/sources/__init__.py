"""Readers, writers, stage control and model tables."""
