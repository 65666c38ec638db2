"""Readers; every reader has an explicit schema."""
