"""Readers. Every one states its schema; none infers it from the data."""
